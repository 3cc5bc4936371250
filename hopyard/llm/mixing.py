"""Mixing sources to target weights by pivotal rounding."""

from __future__ import annotations

import hashlib
import math
import random

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopyard.session import materialize

#: Rows that one task rounds, and fractions that one step of the tree combines.
ROWS, FAN_IN = 20_000, 64


def plain_label(label: Column) -> Column:
    """Lower case, with ``_`` for runs of white space, ``-`` and ``_``; null for blank."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(F.regexp_replace(label, r"(?U)[\s_-]+", " "))), " ", "_"), F.lit(""))


def _pivot(keys: list, sizes: list[float], parts: list[float], seed: int, last: bool) -> list[float]:
    """Round the fractions to 0 or 1 pair by pair: size moves between two rows, at random in either direction with the
    odds that keep each row's expectation, until one of them is whole. The total size stays. One fraction may remain;
    ``last``: it is drawn too."""
    rng = random.Random(int.from_bytes(hashlib.blake2b(repr((seed, sorted(map(str, keys))[:1])).encode(), digest_size=8).digest(), "big"))
    parts = list(parts)
    held = None
    for i in range(len(parts)):
        if parts[i] < 1e-9 or parts[i] > 1 - 1e-9:
            parts[i] = round(parts[i])
            continue
        if held is None:
            held = i
            continue
        j = held
        up = min((1 - parts[i]) * sizes[i], parts[j] * sizes[j])
        down = min(parts[i] * sizes[i], (1 - parts[j]) * sizes[j])
        move = up if rng.random() * (up + down) < down else -down
        parts[i], parts[j] = parts[i] + move / sizes[i], parts[j] - move / sizes[j]
        whole = [x for x in (i, j) if min(parts[x], 1 - parts[x]) < 1e-9]
        for x in whole:
            parts[x] = float(round(parts[x]))
        rest = [x for x in (i, j) if x not in whole]
        held = rest[0] if rest else None
    if held is not None and last:
        parts[held] = float(rng.random() < parts[held])
    return parts


def _step(df: DataFrame, by: list[str], seed: int, last: bool) -> DataFrame:
    def run(part: pd.DataFrame) -> pd.DataFrame:
        # Largest first, so that the fraction that stays open at the end is one of a small row.
        part = part.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        return part.assign(part=_pivot(part["id"].tolist(), part["size"].tolist(), part["part"].tolist(), seed, last))

    return df.groupBy(*by).applyInPandas(run, df.schema)


def mix(df: DataFrame, targets: DataFrame, seed: int = 0, total: float | None = None, group_rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """How often each row is used so that each source has its share of the total size.

    :param df: (id, source, size bigint), ids unique; labels as in ``targets``. Rows without a target, or of size 0,
        are used 0 times.
    :param targets: (source, target_share, max_repeat). A missing source has no rows. Bounded by the number of sources,
        which comes to the driver as one small aggregate.
    :param total: total size; by default the largest that every source can fill with its share. A source that can't
        fill its share of a larger total gets ``max_repeat`` copies of every row.
    :return: copies (id, source, size, copies int), one row for each row of ``df``, and report (source, target_share,
        actual_share, docs, used_docs, size, most_copies).

    Rows of a source are cut at random into groups of about ``group_rows``, whatever the source's size; each group leaves
    at most one fraction, and a tree combines these ``FAN_IN`` at a time.
    """
    want = targets.select(F.col("source").alias("_source"), F.col("target_share").cast("double").alias("_share"), F.col("max_repeat").cast("int").alias("_most"))
    has = df.where(F.col("size") > 0).groupBy("source").agg(F.sum("size").alias("_has"), F.count(F.lit(1)).alias("_n"))
    plan = want.join(has, want["_source"] == has["source"], "left").drop("source")
    known = plan.collect()
    if total is None:
        total = min((r["_most"] * r["_has"] / r["_share"] for r in known if r["_has"] and r["_share"]), default=0.0)
    groups = math.ceil(max([1, *(r["_n"] or 0 for r in known)]) / group_rows)
    rows = df.select("id", "source", F.col("size").cast("double").alias("size")).join(F.broadcast(plan), F.col("source") == F.col("_source"), "left")
    rate = F.when(F.col("size") > 0, F.least(F.col("_share") * F.lit(float(total)) / F.col("_has"), F.col("_most").cast("double")))
    rated = rows.withColumn("_rate", F.coalesce(rate, F.lit(0.0))).withColumn("base", F.floor(F.col("_rate") + 1e-12).cast("int"))
    own = F.ceil(F.coalesce(F.col("_n"), F.lit(1)) / group_rows)
    start = rated.select(
        "id", "source", "size", "base", F.greatest(F.col("_rate") - F.col("base"), F.lit(0.0)).alias("part"),
        F.pmod(F.xxhash64(F.lit(seed), "id"), own).alias("group"),
    )
    live = _step(start.where("part > 0"), ["source", "group"], seed, groups == 1)
    done = start.where("part <= 0")
    while groups > 1:
        live = materialize(live, "fractions")
        done = done.unionByName(live.where("part = 0 or part = 1"))
        groups = math.ceil(groups / FAN_IN)
        live = _step(live.where("part > 0 and part < 1").withColumn("group", F.floor(F.col("group") / FAN_IN)), ["source", "group"], seed, groups == 1)
    copies = materialize(done.unionByName(live).select("id", "source", F.col("size").cast("bigint").alias("size"), (F.col("base") + F.col("part").cast("int")).alias("copies")), "copies")
    used = copies.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.count_if(F.col("copies") > 0).alias("used_docs"), F.sum(F.col("copies") * F.col("size")).alias("size"), F.max("copies").alias("most_copies")
    )
    report = want.join(used, want["_source"] == used["source"], "left").crossJoin(F.broadcast(copies.agg(F.sum(F.col("copies") * F.col("size")).alias("_all"))))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return copies, report.select(
        F.col("_source").alias("source"), F.col("_share").alias("target_share"), F.coalesce(F.try_divide("size", "_all"), F.lit(0.0)).alias("actual_share"), zero("docs"), zero("used_docs"), zero("size"), zero("most_copies")
    )
