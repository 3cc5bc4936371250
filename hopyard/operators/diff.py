"""What changed between full snapshots."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def _nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else " ".join(unicodedata.normalize("NFC", x).split()))


def clean_name(name: Column) -> Column:
    """NFC, with single spaces and none at the ends; null stays null. Spark has no function for NFC."""
    return _nfc(name)


def latest(df: DataFrame, keys: list[str], order: str, values: dict[str, Column]) -> DataFrame:
    """The row with the greatest ``order`` for each ``keys``: aggregated before the shuffle, so that a key with very
    many rows is one row per task there."""
    best = F.max(F.struct(F.col(order).alias("_o"), *[v.alias(n) for n, v in values.items()])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{n}").alias(n) for n in values])


def neighbours(df: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """(before, after): the rows of each snapshot but the last under the number of the next delivered one, and the rows
    of each but the first. A null number belongs to no snapshot."""
    # One row per snapshot: the window over them stays small however large the snapshots are.
    numbers = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct()
    follows = numbers.withColumn("_next", F.lead(snapshot).over(Window.orderBy(snapshot))).where(F.col("_next").isNotNull())
    after = df.join(F.broadcast(numbers.agg(F.min(snapshot).alias("_first"))), F.col(snapshot) > F.col("_first")).drop("_first")
    before = df.join(follows, snapshot).withColumn(snapshot, F.col("_next")).drop("_next")
    return before.select(*df.columns), after.select(*df.columns)


def snapshot_changes(df: DataFrame, snapshot: str, key: str, order: str, values: dict[str, Column]) -> DataFrame:
    """Added, removed and changed keys of each snapshot since the one delivered before it.

    All pairs of neighbours are compared in one pass: each row stands once as a row of its own snapshot and once as
    the row before the next delivered one. EXCEPT ALL both ways leaves the rows that differ; a full join of these by
    key tells which are only new, only old or both.

    :param df: all snapshots. Rows with a null or empty ``key`` or a null ``snapshot`` are ignored; of a key's rows in
        a snapshot the one with the greatest ``order`` (unique) holds. Further columns play no part.
    :param values: the compared expressions by name; null is a value. Numbers never delivered are passed over.
    :return: (snapshot, key, change). Empty for no table, or for a single snapshot.
    """
    kept = df.where(F.col(key).isNotNull() & (F.col(key) != "") & F.col(snapshot).isNotNull())
    rows = latest(kept, [snapshot, key], order, values)
    # One row per snapshot: the window over them stays small however large the snapshots are.
    numbers = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct()
    follows = numbers.withColumn("_next", F.lead(snapshot).over(Window.orderBy(snapshot)))
    first = numbers.agg(F.min(snapshot).alias("_first"))
    new = rows.join(F.broadcast(first), F.col(snapshot) != F.col("_first")).select(F.col(snapshot).alias("_s"), F.col(key).alias("_k"), *values)
    old = rows.join(follows.where(F.col("_next").isNotNull()), snapshot).select(F.col("_next").alias("_s"), F.col(key).alias("_k"), *values)
    added, gone = new.exceptAll(old), old.exceptAll(new)
    both = added.select("_s", "_k", F.lit(True).alias("_n")).join(gone.select("_s", "_k", F.lit(True).alias("_o")), ["_s", "_k"], "full")
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed")
    return both.select(F.col("_s").alias(snapshot), F.col("_k").alias(key), change.alias("change"))
