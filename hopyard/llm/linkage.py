"""Probabilistic record linkage without keys: blocking in several passes, agreement levels, expectation-maximisation of
match and non-match probabilities, posterior as confidence."""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopyard.llm import places
from hopyard.session import materialize

ROUNDS = 30
#: Levels of agreement of an attribute: it differs, is missing on a side, agrees in part, agrees.
DIFFERS, MISSING, PARTLY, AGREES = range(4)
#: ``own``: the words of a name, parted by spaces; ``address``: its components, parted by bars; both empty for none.
_KEYS = "own string, address string, phone string, blocks array<string>, short array<string>, names array<int>"


def _short(own: tuple, bare: bool, phone: str, right: bool) -> list[str]:
    """Blocks of seven digits, in which the pairs meet that no other block is sure to find: those with an address blank
    on a side and a phone of seven digits on a side. Both sides name the pair of kinds that meets."""
    if not phone or not own:
        return []
    kind = lambda seven, bare: 2 * seven + bare
    seven = len(phone) == 7
    others = [kind(s, b) for s in (False, True) for b in (False, True) if (seven or s) and (bare or b)]
    return [f"{phone[-7:]}:{o}{kind(seven, bare)}" if right else f"{phone[-7:]}:{kind(seven, bare)}{o}" for o in others]


def _keyed(parts: Iterator[pd.DataFrame], right: bool) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for form, name, address, phone in zip(part["form"], part["name"], part["address"], part["phone"]):
            own, a, p = _words(name), _address(address), places.phone_digits(phone)
            blocks = [f"p{p}"] if len(p) == 10 else []
            # Seven digits are shared by many; with initials they find numbers given without their area. Where no address
            # helps, names of other initials meet in ``short``.
            blocks += [f"q{p[-7:]}{own[0][0]}{own[-1][0]}"] if p and own else []
            blocks += [f"a{k}" for k in places.street_keys(a)] if a else []
            # Names alone say too little; with the town, or the first letters of the street, they find what misses a number.
            if own and a:
                blocks += [f"n{own[0][:4]}{own[-1][-3:]}:{a.number}"]
            short = _short(own, a is None, p, right)
            names = [zlib.crc32(k.encode()) >> 1 for k in places.name_keys(own, right)] if short else []
            rows.append((form, " ".join(own), "|".join(a) if a else "", p, blocks, short, names))
        yield pd.DataFrame(rows, columns=["form", "own", "address", "phone", "blocks", "short", "names"])


@lru_cache(maxsize=1 << 17)
def _words(name: str | None) -> tuple[str, ...]:
    return places.name_words(name)[0]


_address = lru_cache(maxsize=1 << 17)(places.parse_address)


def forms(df: DataFrame, right: bool) -> tuple[DataFrame, DataFrame]:
    """Distinct (name, address, phone) with their parts and blocks, and (id, form) of each row with two or more of them.

    :param right: whether the rows are the right side of the pairs.
    """
    text = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")), F.lit(""))
    rows = df.select("id", *[text(c).alias(c) for c in ("name", "address", "phone")])
    rows = rows.where(sum(F.col(c).isNotNull().cast("int") for c in ("name", "address", "phone")) >= 2)
    rows = rows.withColumn("form", F.xxhash64("name", "address", "phone", F.col("name").isNull(), F.col("address").isNull(), F.col("phone").isNull()))
    distinct = rows.dropDuplicates(["form"]).select("form", "name", "address", "phone")
    return materialize(distinct.mapInPandas(partial(_keyed, right=right), f"form bigint, {_KEYS}"), "forms"), rows.select("id", "form")


@lru_cache(maxsize=1 << 17)
def name_level(x: str, y: str) -> int:
    """Agreement of two names, each its own words parted by spaces."""
    if not x or not y:
        return MISSING
    if x == y:
        return AGREES
    a, b = tuple(x.split()), tuple(y.split())
    if places.same_name(a, b):
        return AGREES
    return PARTLY if places.holds_name(a, b) else DIFFERS


@lru_cache(maxsize=1 << 17)
def address_level(x: str, y: str) -> int:
    """Agreement of two addresses, each its components parted by bars; in part where number and street agree but for the
    direction or type."""
    if not x or not y:
        return MISSING
    if x == y:
        return AGREES
    m, n = (places.Address(*v.split("|")) for v in (x, y))
    if places.same_location(m, n):
        return AGREES
    near = m.number == n.number and places.close(m.street, n.street)
    return PARTLY if near and not (m.zip and n.zip and m.zip != n.zip) and not (m.unit and n.unit and m.unit != n.unit) and not (m.town and n.town and not places.close(m.town, n.town)) and not (m.direction and n.direction and m.direction != n.direction) else DIFFERS


def phone_level(p: str, q: str) -> int:
    return MISSING if not p or not q else AGREES if p == q else PARTLY if len(p) != len(q) and p[-7:] == q[-7:] else DIFFERS


Pattern = tuple[int, int, int]
#: What a pair may be, with a first guess of its share and of how often name, address and phone differ, agree in part,
#: agree. Only the first is a match; branches share a name and often a phone, neighbours a location, and taking both
#: for chance would make the model sure of pairs that two attributes speak for and the third rules out.
KINDS = {
    "same place": (0.5, ((0.005, 0.05, 0.945), (0.003, 0.002, 0.995), (0.03, 0.07, 0.9))),
    "branch": (0.1, ((0.03, 0.07, 0.9), (0.9, 0.095, 0.005), (0.4, 0.1, 0.5))),
    "neighbour": (0.1, ((0.95, 0.045, 0.005), (0.03, 0.02, 0.95), (0.7, 0.05, 0.25))),
    "chance": (0.3, ((0.9, 0.05, 0.05), (0.9, 0.05, 0.05), (0.9, 0.05, 0.05))),
}
#: The first guess counts as so many pairs of a kind; and what a kind excludes stays at most the guess.
GUESS = 50
_EXCLUDED = {("same place", 0, DIFFERS), ("same place", 1, DIFFERS), ("same place", 1, PARTLY), ("branch", 1, AGREES), ("neighbour", 0, AGREES)}
_LEVELS = (DIFFERS, PARTLY, AGREES)


def fit(counts: dict[Pattern, int]) -> dict[Pattern, float]:
    """The posterior of a match by pattern of agreement, by expectation-maximisation over the patterns' counts. An
    attribute that is missing says nothing."""
    share = {k: v[0] for k, v in KINDS.items()}
    guess = {(k, i): dict(zip(_LEVELS, row)) for k, (_, rows) in KINDS.items() for i, row in enumerate(rows)}
    prob = dict(guess)

    def posterior(pattern: Pattern) -> dict[str, float]:
        joint = {k: share[k] * math.prod(prob[k, i][level] for i, level in enumerate(pattern) if level != MISSING) for k in KINDS}
        return {k: v / sum(joint.values()) for k, v in joint.items()}

    for _ in range(ROUNDS):
        post = {p: posterior(p) for p in counts}
        size = {k: GUESS * KINDS[k][0] + sum(post[p][k] * n for p, n in counts.items()) for k in KINDS}
        share = {k: v / sum(size.values()) for k, v in size.items()}
        for (k, i), first in guess.items():
            sums = {v: GUESS * first[v] + sum(post[p][k] * n for p, n in counts.items() if p[i] == v) for v in _LEVELS}
            row = {v: x / sum(sums.values()) for v, x in sums.items()}
            row = {v: min(x, first[v]) if (k, i, v) in _EXCLUDED else x for v, x in row.items()}
            prob[k, i] = {v: max(1e-6, x / sum(row.values())) for v, x in row.items()}
    return {p: posterior(p)["same place"] for p in itertools.product(range(4), repeat=3)}


def link(left: DataFrame, right: DataFrame, confidence: float = 0.5) -> DataFrame:
    """Pairs of rows of two tables that describe the same place: (left_id, right_id, confidence).

    :param left: (id, name, address, phone); ``right`` likewise. A pair needs two of these that can be read on both sides.
        Rows that are equal in all three are compared once. Each table may hold several rows of one place.
    :param confidence: the least posterior of a pair that comes out; nothing else decides.
    """
    lf, lm = forms(left, False)
    rf, rm = forms(right, True)
    lb, rb = (f.select(F.col("form").alias(c), F.explode("blocks").alias("block")) for f, c in ((lf, "x"), (rf, "y")))
    ls, rs = (f.select(F.col("form").alias(c), F.explode("short").alias("block"), F.col("names").alias(f"{c}_n")) for f, c in ((lf, "x"), (rf, "y")))
    short = ls.join(rs, "block").where(F.arrays_overlap("x_n", "y_n"))
    pairs = lb.join(rb, "block").select("x", "y").unionByName(short.select("x", "y")).distinct()
    side = lambda f, c: f.select(F.col("form").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("own", "address", "phone")])

    def compare(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            by = lambda f, k: list(map(f, part[f"x_{k}"], part[f"y_{k}"]))
            yield pd.DataFrame({"x": part["x"], "y": part["y"], "n": by(name_level, "own"), "a": by(address_level, "address"), "p": by(phone_level, "phone")})

    compared = materialize(pairs.join(side(lf, "x"), "x").join(side(rf, "y"), "y").mapInPandas(compare, "x bigint, y bigint, n int, a int, p int"), "compared")
    # At most 64 patterns, whatever the number of pairs.
    counts = {(r["n"], r["a"], r["p"]): r["count"] for r in compared.groupBy("n", "a", "p").count().collect()}
    post = fit(counts)
    code = F.col("n") * 16 + F.col("a") * 4 + F.col("p")
    odds = F.element_at(F.array(*[F.lit(post[p]) for p in sorted(post)]), code + 1)
    known = sum((F.col(c) != MISSING).cast("int") for c in ("n", "a", "p"))
    good = compared.where(known >= 2).withColumn("confidence", odds).where(F.col("confidence") >= confidence)
    joined = good.join(lm.select(F.col("form").alias("x"), F.col("id").alias("left_id")), "x").join(rm.select(F.col("form").alias("y"), F.col("id").alias("right_id")), "y")
    return joined.select("left_id", "right_id", "confidence")
