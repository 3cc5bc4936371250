"""New batches against all that was accepted before: multi-key sorted-neighbourhood runs.

Each record stands under several sort keys. A run is a batch's records in key ranges, sorted by key, written once and
never altered. A new batch is merged with the parts of the runs around it in key order, and each new record is compared
with its window: the rows on both sides of it that share the key's leading part. ``FANOUT`` runs are compacted into one.
History isn't parsed or compared again.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopyard.llm import places
from hopyard.session import fresh_path, materialize, remove

FANOUT = 4
#: Rows of a window from which on it is searched by keys of names instead of row by row; the pairs found are the same.
WIDE = 48
#: ``own``: the words of a name, parted by spaces; ``address``: its components, parted by bars, empty for none.
_SCHEMA = "id bigint, root bigint, own string, address string, lead string, key string"
_ROW = ["lead", "key", "own", "address", "fresh", "root"]


def keyed(df: DataFrame, nameless: bool = False) -> DataFrame:
    """(id, root, own, address, lead, key) of (id, root, name, address): a row for each sort key. ``lead`` is the part of a
    key that neighbours share. Rows without a street have no key; with ``nameless`` they stand under their name."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for id_, root, name, address in zip(part["id"], part["root"], part["name"], part["address"]):
                own, a = places.name_words(name)[0], places.parse_address(address)
                if not own or a is None and not nameless:
                    continue
                word = "".join(own)
                keys = [(k, word) for k in places.street_keys(a)] + [(f"{a.number}/{word[:2]}", a.street)] if a else []
                if nameless:
                    keys.append((f"={word}", ""))
                rows += [(id_, root, " ".join(own), "|".join(a) if a else "", lead, f"{lead} {rest}") for lead, rest in dict(keys).items()]
            yield pd.DataFrame(rows, columns=["id", "root", "own", "address", "lead", "key"])

    return df.mapInPandas(run, _SCHEMA)


class Form:
    """A name and an address, new or known: known ones are stood for by their root, new ones by their smallest id."""

    __slots__ = ("text", "own", "address", "fresh", "root")

    def __init__(self, own: str, address: str, fresh: bool, root: int) -> None:
        self.text, self.own, self.fresh, self.root = (own, address), tuple(own.split(" ")), fresh, root
        self.address = places.Address(*address.split("|")) if address else None


def same_place(x: Form, y: Form) -> bool:
    """The locations agree and the names do, or all words of one stand in the other; without a location on a side the
    names must agree."""
    if x.text == y.text:
        return True
    if x.address is None or y.address is None:
        return places.same_name(x.own, y.own)
    if not places.same_location(x.address, y.address):
        return False
    return places.same_name(x.own, y.own) or places.holds_name(x.own, y.own)


def _window(rows: list[Form]) -> Iterator[tuple[int, int]]:
    """Pairs of places in a window of which the first is new; each pair of two new rows once."""
    if len(rows) <= WIDE:
        for i, x in enumerate(rows):
            if x.fresh:
                yield from ((i, j) for j, y in enumerate(rows) if j >= i or not y.fresh)
        return
    names = [places.name_keys(x.own, False) + places.name_keys(x.own, True) for x in rows]
    at: dict[str, list[int]] = {}
    for i, keys in enumerate(names):
        for k in set(keys):
            at.setdefault(k, []).append(i)
    for i, x in enumerate(rows):
        if x.fresh:
            near = set(itertools.chain.from_iterable(at[k] for k in set(names[i])))
            yield from ((i, j) for j in sorted(near) if j >= i or not rows[j].fresh)


def _walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(own, address, other, known) for rows in the order of their keys, one window after the other; a window may go on in
    the next part."""

    def met(rows: list[Form]) -> Iterator[tuple[str, str, int, bool]]:
        for i, j in _window(rows):
            x, y = rows[i], rows[j]
            if same_place(x, y):
                yield *x.text, y.root, not y.fresh
                if y.fresh and i != j:
                    yield *y.text, x.root, False

    lead, rows = None, []
    for part in parts:
        found: set[tuple[str, str, int, bool]] = set()
        for new, own, address, fresh, root in zip(part["lead"], part["own"], part["address"], part["fresh"], part["root"]):
            if new != lead:
                if any(r.fresh for r in rows):
                    found.update(met(rows))
                lead, rows = new, []
            rows.append(Form(own, address, fresh, root))
        yield pd.DataFrame(list(found), columns=["own", "address", "other", "known"])
    if any(r.fresh for r in rows):
        yield pd.DataFrame(list(set(met(rows))), columns=["own", "address", "other", "known"])


class History:
    """Runs of accepted and repeated records in the shared folder, each with the root it repeats (itself if none)."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.runs: list[tuple[int, str]] = []

    def _append(self, df: DataFrame, level: int = 0) -> None:
        """Write a run; runs that are compacted are deleted, as nothing reads them any more."""
        path = fresh_path(self.spark, "history")
        df.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)
        self.runs.append((level, path))
        same = [p for k, p in self.runs if k == level]
        if len(same) >= FANOUT:
            self.runs = [(k, p) for k, p in self.runs if k != level]
            self._append(self.spark.read.schema(_SCHEMA).parquet(*same), level + 1)
            for p in same:
                remove(self.spark, p)

    def seed(self, df: DataFrame) -> None:
        """Take in records without a check: (id, root, name, address). A root less than 0 comes before all others."""
        self._append(keyed(df, nameless=True).where("address <> '' or lead like '=%'"))

    def add(self, batch: DataFrame) -> DataFrame:
        """Check (id, name, address) and take it in: (id, root) of each row with a name and a street. In a batch the
        smaller id is the earlier; a row whose root is its own id is accepted."""
        return self.add_keyed(materialize(keyed(batch.withColumn("root", F.col("id"))), "batch"))

    def add_keyed(self, new: DataFrame) -> DataFrame:
        """As ``add``, of rows that ``keyed`` made; they are read several times, so they should be in a table."""
        name = F.concat(F.lit("="), F.replace("own", F.lit(" "), F.lit("")))
        # The same rows also probe the names of records without a location.
        bare = new.dropDuplicates(["id"]).withColumn("lead", name).withColumn("key", name)
        rows = new.unionByName(bare).select("lead", "key", "own", "address", F.lit(True).alias("fresh"), F.col("id").alias("root"))
        if self.runs:
            # Only what lies around new rows is read on.
            old = self.spark.read.schema(_SCHEMA).parquet(*[p for _, p in self.runs]).where("lead not like '=%' or address = ''")
            old = old.join(rows.select("lead").distinct(), "lead", "left_semi")
            rows = rows.unionByName(old.select("lead", "key", "own", "address", F.lit(False).alias("fresh"), "root"))
        # Rows of one form are one row in a window, which the exchange by lead also serves.
        forms = rows.repartition("lead").groupBy("lead", "own", "address", "fresh").agg(F.min("key").alias("key"), F.min("root").alias("root"))
        merged = forms.select(*_ROW).sortWithinPartitions("lead", "key", "own", "address", "fresh")
        links = merged.mapInPandas(_walk, "own string, address string, other bigint, known boolean")
        first = lambda c: F.min(F.when(c, F.col("other")))
        best = links.groupBy("own", "address").agg(first(F.col("known")).alias("old"), first(~F.col("known")).alias("near"))
        best = new.select("id", "own", "address").distinct().join(best, ["own", "address"], "left").select("id", "old", F.least("near", "id").alias("near"))
        # A row may repeat a row of its own batch that repeats another: follow until nothing changes, in steps that double.
        best, moved = materialize(best, "roots"), 1
        while moved:
            up = best.select(F.col("id").alias("near"), F.col("old").alias("old2"), F.col("near").alias("near2"))
            old, near = F.least("old", "old2"), F.least("near", "near2")
            best = materialize(best.join(up, "near", "left").select("id", old.alias("old"), near.alias("near"), (~old.eqNullSafe(F.col("old")) | (near != F.col("near"))).alias("moved")), "roots")
            moved = best.where("moved").limit(1).count()
            best = best.drop("moved")
        roots = best.select("id", F.coalesce("old", "near", "id").alias("root"))
        self._append(new.drop("root").join(roots, "id").select(*new.columns))
        return roots
