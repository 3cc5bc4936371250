"""One surviving claim for each fact, by truth discovery.

The sources' reliability and the values' support are estimated in turn until they settle. A source family has one vote
on a fact, its latest; a value's support is what the reliability, weight and freshness of its votes add up to.
"""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopyard.llm import places
from hopyard.session import materialize

#: The estimate has settled when no family's trust changes by more in a round; the bound is far beyond what that takes.
SETTLED = 1e-4
ROUNDS = 100
#: Days in which a vote loses half its force.
HALF_LIFE = 30.0
#: What stands where a value is missing.
NO_VALUE = frozenset(["", "?", "-", "--", "n/a", "na", "none", "null", "nil", "tbd", "tba", "unknown", "varies", "call us", "call", "not listed", "coming soon", "see website", "not available"])


def canonical(field: str, value: str | None) -> tuple[str, float]:
    """(key, completeness) of a JSON value: equal for every spelling; an empty key for no value."""
    try:
        x = json.loads(value) if value is not None else None
    except ValueError:
        x = value
    if x is None or isinstance(x, str) and " ".join(x.lower().split()).strip(" .") in NO_VALUE or x in ([], {}):
        return "", 0.0
    if isinstance(x, list):
        items = sorted({json.dumps(_plain(i), sort_keys=True) for i in x})
        return "\n".join(items), float(len(items))
    if not isinstance(x, str):
        return json.dumps(_plain(x), sort_keys=True), 1.0
    if field == "phone":
        digits = places.phone_digits(x)
        return (digits, float(len(digits))) if digits else (re.sub(r"\D", "", x), 0.0)
    if field == "address":
        a = places.parse_address(x)
        return ("|".join(a), float(sum(map(bool, a)))) if a else ("~" + _plain(x), 0.0)
    s = re.sub(r"\s*([-–—])\s*", "-", places.fold(x))
    return " ".join(re.sub(r"\s*([&,;])\s*", r" \1 ", re.sub(r"\s*([-–—])\s*", "-", s)).split()), float(len(re.split(r"[&,;]", s)))


def _plain(x: object) -> object:
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items() if v not in (None, "")}
    if isinstance(x, str):
        return " ".join(places.fold(x).split())
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def covers(field: str, full: str, part: str) -> bool:
    """``part`` says less than ``full`` but nothing else."""
    if full == part:
        return True
    if field == "address" and "|" in full and "|" in part:
        a, b = (places.Address(*v.split("|")) for v in (full, part))
        return places.same_location(a, b) and sum(map(bool, a)) >= sum(map(bool, b))
    if field == "address" and part.startswith("~"):
        return part[1:].replace(" ", "") in full.replace("|", "")
    if field == "phone":
        return len(full) > len(part) and full.endswith(part)
    if "\n" in full or full.startswith("{"):
        return set(part.split("\n")) <= set(full.split("\n"))
    if field in ("hours", "business_hours"):
        split = lambda s: {p.strip() for p in re.split(r"[&,;]", s)}
        return split(part) <= split(full)
    return False


def parse_time(c: Column) -> Column:
    """A timestamp from the ISO forms; null for blank and other texts."""
    return F.try_to_timestamp(F.regexp_replace(F.nullif(F.trim(c), F.lit("")), r"^(\d{4}-\d\d-\d\d)$", "$1T00:00:00Z"))


def _keys(df: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            pairs = [canonical(f, v) for f, v in zip(part["field"], part["value"])]
            yield part.assign(key=[p[0] for p in pairs], full=[p[1] for p in pairs])

    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", key string, full double")


def _wholes(field: str, keys: list[str]) -> list[str]:
    """For the distinct values of one fact: the fullest value that covers each; itself if none does, or if several that
    differ do."""
    found = []
    for k in keys:
        above = [f for f in keys if f != k and covers(field, f, k)]
        tops = [f for f in above if not any(g != f and covers(field, g, f) and not covers(field, f, g) for g in above)]
        alone = all(covers(field, tops[0], t) or covers(field, t, tops[0]) for t in tops)
        found.append(max(tops, key=lambda t: (len(t), t)) if tops and alone else k)
    return found


def _complete(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = [(v, f, k, w) for v, f, field, keys in zip(part["v"], part["f"], part["field"], part["keys"]) for k, w in zip(keys, _wholes(field, list(keys)))]
        yield pd.DataFrame(rows, columns=["v", "f", "key", "whole"])


def surviving(df: DataFrame, as_of: str) -> DataFrame:
    """(venue_id, field, claim_id) for every fact with two or more claims and at least one value.

    :param df: (claim_id, venue_id, field, value, observed_at, source_family, weight). Claims without a value take no
        part in the vote; one with a blank time is as old as the oldest; a null weight counts 0. A null venue or field
        is a fact of its own. Of the claims that carry the chosen value completely: the greatest weight, then the
        latest, then the smallest id.

    Votes are reduced by fact, value and family before anything is grouped by fact, so a fact with very many claims
    costs what its distinct values cost.
    """
    cols = ["claim_id", "venue_id", "field", "value", "source_family", "weight", "seen"]
    rows = df.withColumn("seen", parse_time(F.col("observed_at"))).select(*cols)
    rows = materialize(_keys(rows.withColumn("seen", F.unix_micros(F.col("seen").cast("timestamp")).cast("bigint"))), "claims")
    fact = [F.coalesce("venue_id", F.lit("\0")).alias("v"), F.coalesce("field", F.lit("\0")).alias("f")]
    rows = rows.select(*fact, *rows.columns)
    several = rows.groupBy("v", "f").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("v", "f")
    valued = rows.where("key <> ''").join(several, ["v", "f"])
    values = valued.groupBy("v", "f", "field").agg(F.collect_set("key").alias("keys"))
    whole = values.mapInPandas(_complete, "v string, f string, key string, whole string")
    valued = materialize(valued.join(whole, ["v", "f", "key"]), "valued")
    end = F.unix_micros(F.lit(as_of).cast("timestamp"))
    age = F.greatest((end - F.coalesce("seen", F.lit(0))) / F.lit(86_400e6), F.lit(0.0))
    force = (0.05 + F.coalesce("weight", F.lit(0.0))) * F.pow(F.lit(0.5), age / HALF_LIFE)
    families = valued.withColumn("force", force).groupBy("v", "f", "source_family", "whole").agg(F.max(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "force")).alias("last"))
    newest = Window.partitionBy("v", "f", "source_family").orderBy(F.desc("last"), "whole")
    votes = families.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    votes = materialize(votes.select("v", "f", F.coalesce("source_family", F.lit("")).alias("family"), "whole", F.col("last.force").alias("force"), F.col("last.seen").alias("seen")), "votes")
    trust = votes.select("family").distinct().withColumn("trust", F.lit(0.7))

    def supported(trust: DataFrame) -> DataFrame:
        sure = F.ln((F.col("trust") + 0.02) / (1.02 - F.col("trust"))) + 2.0
        scored = votes.join(trust, "family").withColumn("s", F.greatest(sure, F.lit(0.05)) * F.col("force"))
        support = scored.groupBy("v", "f", "whole").agg(F.sum("s").alias("s"), F.max("seen").alias("seen"))
        return support.withColumn("p", F.col("s") / F.sum("s").over(Window.partitionBy("v", "f")))

    for _ in range(ROUNDS):
        # Support of each value; how often each family's vote is for a supported one.
        share = supported(trust).select("v", "f", "whole", "p")
        got = votes.join(share, ["v", "f", "whole"]).groupBy("family").agg(((F.sum("p") + 1.4) / (F.count(F.lit(1)) + 2)).alias("trust"))
        before, trust = trust.withColumnRenamed("trust", "before"), materialize(got, "trust")
        change = trust.join(before, "family").agg(F.max(F.abs(F.col("trust") - F.col("before")))).first()[0]
        if (change or 0.0) < SETTLED:
            break
    else:
        warnings.warn(f"trust still changes by {change:.2g} after {ROUNDS} rounds", stacklevel=2)
    share = supported(trust)
    first = Window.partitionBy("v", "f").orderBy(F.desc("s"), F.desc("seen"), "whole")
    chosen = share.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("v", "f", "whole")
    held = valued.join(chosen, ["v", "f", "whole"])
    top = held.groupBy("v", "f").agg(F.max("full").alias("top"))
    best = held.join(top, ["v", "f"]).where((F.col("key") == F.col("whole")) | (F.col("full") >= F.col("top")))
    pick = F.max(F.struct(F.coalesce("weight", F.lit(0.0)), F.coalesce("seen", F.lit(0)), -F.col("claim_id"), "claim_id", "venue_id", "field")).alias("b")
    return best.groupBy("v", "f").agg(pick).select("b.venue_id", "b.field", "b.claim_id")
