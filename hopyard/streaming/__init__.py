"""Structured Streaming forms of the operators that keep state between runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_arrivals(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key's first row within the watermark; later repeats are dropped. ``time`` may be without a zone."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], length: str, delay: str) -> DataFrame:
    """Rows by window and key, final once the watermark has passed the window."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp"))
    return timed.withWatermark(time, delay).groupBy(F.window(time, length), *by).count()
