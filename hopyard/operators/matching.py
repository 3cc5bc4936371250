"""Records against known records by equal keys: duplicates, removed places, best partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hopyard.functions import text


def _keys(df: DataFrame, id_: str, name: Column, address: Column) -> DataFrame:
    blank = lambda c: F.nullif(c, F.lit(""))
    return df.select(F.col(id_).alias("id"), blank(text.norm_name(name)).alias("name"), blank(text.street_number(address)).alias("number"), blank(text.norm_address(address)).alias("address"))


def _meet(left: DataFrame, right: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(id) of left rows that share one of the pairs of keys with a right row. A null key meets nothing, so a hot blank
    is never joined; right keys are distinct, so a hot key makes no more rows than the left has."""
    hits = [left.join(right.select(*p).dropna().distinct(), list(p), "left_semi").select("id") for p in pairs]
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out.distinct()


def duplicates(rows: DataFrame, id_: str, known: DataFrame, known_id: str) -> DataFrame:
    """(id) of rows (name, address) that a known row repeats: the name and the house number or address agree, or house
    number and address do whatever the name. A name alone never does."""
    left, right = (_keys(df, i, F.col("name"), F.col("address")) for df, i in ((rows, id_), (known, known_id)))
    return _meet(left, right, (("name", "number"), ("name", "address"), ("number", "address"))).withColumnRenamed("id", id_)


def removed(rows: DataFrame, id_: str, gone: DataFrame) -> DataFrame:
    """(id) of rows (name, address) that name a removed place (name, norm_name, norm_address): the name agrees, and the
    house number or the address. Stored keys are normalised again, as an older normaliser may have made them."""
    left = _keys(rows, id_, F.col("name"), F.col("address"))
    name = F.coalesce(F.nullif(text.norm_name(F.col("name")), F.lit("")), text.norm_name(F.col("norm_name")))
    right = gone.select(F.nullif(name, F.lit("")).alias("name"), *[F.nullif(f(F.col("norm_address")), F.lit("")).alias(k) for k, f in (("number", text.street_number), ("address", text.norm_address))])
    return _meet(left, right, (("name", "number"), ("name", "address"))).withColumnRenamed("id", id_)


def best_partner(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l_id, r_id, score): the best right row of each left row, of (id, name, address, phone).

    One name must hold the other and a phone or house number agree, for 0.8, with the phone 1.0; a left row with neither
    address nor phone takes a row of the very same name. The smallest right id on ties. Pairs are made by phone, by whole
    name, or by house number with a part of the name: the four letters a name begins with stand somewhere in the name
    that holds it, so a house number that very many places share is split by these.
    """

    def keyed(df: DataFrame, p: str, other: str, bare: Column) -> DataFrame:
        k, address = f"{p}_k", F.col(f"{p}_address")
        letters = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(F.col(f"{p}_name"), F.lit(""))), r"\bthe ", ""), "[^a-z0-9]+", "")
        number = F.nullif(F.regexp_extract(F.regexp_replace(F.lower(F.coalesce(address, F.lit(""))), "[^a-z0-9]+", ""), r"^(\d+)", 1), F.lit(""))
        rows = df.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "name", "address", "phone")]).withColumn(k, letters).where(F.col(k) != "").withColumn("_no", number)
        # Each side names itself as the one that is held, by its beginning, and as the one that holds, by all parts.
        short = F.length(k) < 4
        parts = F.when(short, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(k) - 3), lambda i: F.substring(F.col(k), i, F.lit(4))))
        held = F.concat(F.lit(f"s{p}"), F.col("_no"), F.lit(":"), F.when(short, "*").otherwise(F.left(F.col(k), F.lit(4))))
        holds = F.transform(F.array_distinct(F.concat(parts, F.array(F.lit("*")))), lambda g: F.concat(F.lit(f"s{other}"), F.col("_no"), F.lit(":"), g))
        blocks = F.concat(F.array(F.concat(F.lit("p"), text.phone_key(F.col(f"{p}_phone"))), F.when(bare, F.concat(F.lit("n"), F.col(k))), held), holds)
        return rows.select("*", F.explode(F.array_distinct(F.array_compact(blocks))).alias("block")).drop("_no")

    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    pairs = keyed(left, "l", "r", blank("l_address") & blank("l_phone")).join(keyed(right, "r", "l", F.lit(True)), "block").where(F.contains("l_k", F.col("r_k")) | F.contains("r_k", F.col("l_k")))
    score = F.when(F.max(F.col("block").startswith("p")), 1.0).otherwise(0.8)
    scored = pairs.groupBy("l_id", "r_id").agg(score.alias("score"))
    return scored.groupBy("l_id").agg(F.max(F.struct("score", (-F.col("r_id")).alias("r"))).alias("b")).select("l_id", (-F.col("b.r")).alias("r_id"), "b.score")


def first_known(gone: DataFrame, venues: DataFrame) -> DataFrame:
    """(key, venue): of each vanished place (key, name, address) the first venue (venue, name, address) of the very same
    name whose street token isn't another; a missing token contradicts nothing."""
    letters = lambda c: F.nullif(F.regexp_replace(F.regexp_replace(F.lower(c), r"\bthe ", ""), "[^a-z0-9]+", ""), F.lit(""))
    token = lambda c: F.nullif(text.street_token(c), F.lit(""))
    g = gone.select("key", letters(F.col("name")).alias("n"), token(F.col("address")).alias("gt"))
    v = venues.select("venue", letters(F.col("name")).alias("n"), token(F.col("address")).alias("vt"))
    met = g.join(v, "n").where("gt is null or vt is null or gt = vt")
    return met.groupBy("key").agg(F.min("venue").alias("venue"))


def contaminated(pages: DataFrame, name: Column, address: Column, strict: Column) -> DataFrame:
    """Pages (text) that don't name their venue; with ``strict`` they must also hold its street token, if it has one."""
    flat = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "")
    named = flat(F.regexp_replace(name, "[Tt]he ", ""))
    ok = (named != "") & F.contains(flat(F.col("text")), named)
    token = text.street_token(address)
    return pages.where(~(ok & (~strict | (token == "") | F.contains(flat(F.col("text")), token))))
