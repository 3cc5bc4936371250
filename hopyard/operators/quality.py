"""Checks of records as rows of violations, and the comparison of a table with the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filled(c: Column, kind: str) -> Column:
    """Neither null nor an empty text or list."""
    return c.isNotNull() & ((F.size(c) > 0) if kind.startswith("array") else (c != "") if kind == "string" else F.lit(True))


def violations(df: DataFrame, id_: str, rules: dict[str, Column], details: dict[str, Column] | None = None) -> DataFrame:
    """(rule, id, detail): one row for each rule that a row breaks. All rules are tried in one pass.

    :param rules: conditions that a row must meet; null counts as broken. ``details``: what to tell of a broken rule.
    """
    details = details or {}
    broken = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(n).alias("rule"), details.get(n, F.lit("")).cast("string").alias("detail"))) for n, ok in rules.items()])
    return df.select(F.col(id_).alias("id"), F.explode(F.array_compact(broken)).alias("b")).select("b.rule", "id", "b.detail")


def repeated(df: DataFrame, id_: str) -> DataFrame:
    """(rule, id, detail) of ids that stand more than once, with how often. Counted before the shuffle, so one id may hold
    any share of the rows."""
    n = df.groupBy(F.col(id_).alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.select(F.lit("repeated_id").alias("rule"), "id", F.col("n").cast("string").alias("detail"))


def parity(left: DataFrame, right: DataFrame, id_: str) -> DataFrame:
    """(rule, id, detail) of ids that only one of two tables has."""
    ids = lambda df: df.select(id_).dropna().distinct()
    only = lambda a, b, side: ids(a).join(ids(b), id_, "left_anti").select(F.lit("only_" + side).alias("rule"), F.col(id_).alias("id"), F.lit("").alias("detail"))
    return only(left, right, "left").unionByName(only(right, left, "right"))


def deep_parity(left: DataFrame, right: DataFrame, id_: str, fields: list[str]) -> DataFrame:
    """(rule, id, detail): fields that both tables have under one id and that differ where the left is filled."""
    kinds = dict(left.dtypes)
    both = left.select(id_, *fields).join(right.select(id_, *[F.col(f).alias(f"_{f}") for f in fields]), id_)
    off = F.array(*[F.when(filled(F.col(f), kinds[f]) & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields])
    return both.select(F.lit("differs").alias("rule"), F.col(id_).alias("id"), F.explode(F.array_compact(off)).alias("detail"))


def compared(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys, state, lost): each key of either table with ``missing``, ``new``, ``changed`` or ``same``, and the fields
    that were filled before and aren't now. A full join on the keys; null equals null."""
    kinds = dict(before.dtypes)
    side = lambda df, p: df.select(*keys, F.lit(True).alias(p), *[F.col(f).alias(f"{p}{f}") for f in fields])
    both = side(before, "_b").join(side(after, "_a"), keys, "full")
    differs = F.lit(False)
    for f in fields:
        differs = differs | ~F.col(f"_b{f}").eqNullSafe(F.col(f"_a{f}"))
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "new").when(differs, "changed").otherwise("same")
    lost = F.array_compact(F.array(*[F.when(filled(F.col(f"_b{f}"), kinds[f]) & ~filled(F.col(f"_a{f}"), kinds[f]), F.lit(f)) for f in fields]))
    return both.select(*keys, state.alias("state"), lost.alias("lost"))


def regression(states: DataFrame, by: list[str], most_lost: dict[str, int], most_changed: int) -> DataFrame:
    """(by, counts, verdict) of ``compared`` rows: ``fail`` for a smaller table, a missing key or more keys that lost a field
    than allowed, ``review`` for more than ``most_changed`` new or changed keys, else ``pass``.

    :param most_lost: how many keys may lose a field, by field.
    """
    n = lambda s: F.count_if(F.col("state") == s)
    lost = {f: F.count_if(F.array_contains("lost", f)).alias(f"lost_{f}") for f in most_lost}
    sums = states.groupBy(*by).agg((F.count(F.lit(1)) - n("new")).alias("before"), (F.count(F.lit(1)) - n("missing")).alias("after"), n("missing").alias("missing"), n("new").alias("fresh"), n("changed").alias("changed"), *lost.values())
    bad = (F.col("after") < F.col("before")) | (F.col("missing") > 0)
    for f, most in most_lost.items():
        bad = bad | (F.col(f"lost_{f}") > most)
    return sums.withColumn("verdict", F.when(bad, "fail").when(F.col("fresh") + F.col("changed") > most_changed, "review").otherwise("pass"))
