"""Address records that denote the same location: a set-containment join.

Addresses are cut into components; rows of the same components are one form. A form is indexed under its tokens of
number and street, the rarest first (whatever contains an address has these; towns, ZIPs and units are shared by far
too many to be anyone's rarest). One token isn't enough, as a slip of the pen makes up to three of the four rare by
themselves and leaves only the commonest whole. Each form probes the index with all its tokens; a pair holds if either
form contains, by weight, what both name and no component contradicts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopyard.llm import places
from hopyard.session import materialize

#: All that a form has.
INDEXED = 4
CONTAINED = 0.8
FIELDS = places.Address._fields
_SCHEMA = ", ".join(f"{f} string" for f in FIELDS)


def parsed(df: DataFrame) -> DataFrame:
    """(id, number, street, ...): the components of (id, address); rows without a street are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, *a) for k, t in zip(part["id"], part["address"]) if (a := places.parse_address(t))]
            yield pd.DataFrame(rows, columns=["id", *FIELDS])

    return df.where(F.trim("address") != "").mapInPandas(run, f"id {dict(df.dtypes)['id']}, {_SCHEMA}")


def _tokens(forms: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"token": [places.street_keys(places.Address(*r)) for r in part[list(FIELDS)].itertuples(index=False)], "form": part["form"]})

    return forms.mapInPandas(run, "token array<string>, form bigint").select("form", F.explode("token").alias("token"))


def same_location(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs of forms that denote one location, and each row's form.

    :param df: (id, address). Null, blank and street-less addresses have no form.
    :return: pairs (x, y) of form numbers, x < y, and members (id, form).
    """
    rows = parsed(df).withColumn("form", F.xxhash64(*FIELDS))
    rows = materialize(rows, "addresses")
    forms = rows.select("form", *FIELDS).distinct()
    tokens = materialize(_tokens(forms), "tokens")
    seen = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = tokens.join(seen, "token").groupBy("form").agg(F.slice(F.array_sort(F.collect_list(F.struct("n", "token"))), 1, INDEXED).alias("rare"))
    index = ranked.select(F.col("form").alias("y"), F.explode("rare.token").alias("token"))
    pairs = tokens.withColumnRenamed("form", "x").join(index, "token").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda c: forms.select(F.col("form").alias(c), F.struct(*FIELDS).alias(f"{c}_a"))
    checked = pairs.join(side("x"), "x").join(side("y"), "y").mapInPandas(_verify, "x bigint, y bigint")
    return checked, rows.select("id", "form")


def _weight(name: str) -> float:
    return {"number": 4.0, "street": 4.0, "unit": 1.0, "town": 1.5, "zip": 1.5}.get(name, 0.5)


def contains(a: places.Address, b: places.Address) -> bool:
    """Two addresses have the components that both name in common: ``CONTAINED`` of their weight or more. What is missing
    on a side is no difference."""
    total = sum(_weight(n) for n, v, w in zip(FIELDS, a, b) if v and w)
    held = sum(_weight(n) for n, v, w in zip(FIELDS, a, b) if v and w and places.close(v, w))
    return held >= CONTAINED * total


def _verify(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for x, y, p, q in zip(part["x"], part["y"], part["x_a"], part["y_a"]):
            a, b = (places.Address(**v) for v in (p, q))
            if places.same_location(a, b) and contains(a, b):
                rows.append((x, y))
        yield pd.DataFrame(rows, columns=["x", "y"])


def expand(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: all pairs of rows of equal or paired forms."""
    a, b = members.select(F.col("form").alias("x"), F.col("id").alias("p")), members.select(F.col("form").alias("y"), F.col("id").alias("q"))
    across = pairs.join(a, "x").join(b, "y").select("p", "q")
    within = a.join(b.withColumnRenamed("y", "x"), "x").where("p < q").select("p", "q")
    return across.unionByName(within).select(F.least("p", "q").alias("rec_a"), F.greatest("p", "q").alias("rec_b"))
