"""Long spans that stand verbatim in more than one text: a log-structured index of window fingerprints.

Each text is cut into windows of ``WINDOW`` code points, of which winnowing keeps the least hash of every
``span - WINDOW + 1`` neighbours: a span of ``span`` code points holds at least one kept window, the same in every text.
A run is a batch's kept windows, sorted by hash and never altered. A new batch is merge-joined with all runs and with
itself; every match is verified in the texts and grown to its full length. When a level has ``FANOUT`` runs, they
are merged into one of the next level.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopyard.session import fresh_path, materialize

WINDOW = 120
FANOUT = 4
REPEATS = 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse, kept for the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
        return self.up[:n], self.down[:n]


def window_hashes(text: str, k: int, powers: _Powers) -> np.ndarray:
    """The hash of each window of ``k`` code points, by differences of one running sum."""
    c = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    n = len(c)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * up[:n])])
    return _mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def winnow(h: np.ndarray, w: int) -> np.ndarray:
    """Places of the least (leftmost of equal) of every ``w`` neighbours; of all, when there are fewer. Which places of
    a span are kept so depends on the span alone. A hash is ordered by its upper 44 bits, with the place below them."""
    if len(h) <= w:
        return np.array([int(np.argmin(h >> np.uint64(20)))]) if len(h) else np.zeros(0, np.int64)
    return np.unique(np.concatenate([_winnow(h[c : c + 2**20], w) + c for c in range(0, len(h) - w + 1, 2**20 - w)]))


def _winnow(h: np.ndarray, w: int) -> np.ndarray:
    n, low = len(h), np.uint64(2**20 - 1)
    keys = (h & ~low) | np.arange(n, dtype=np.uint64)
    rows = np.concatenate([keys, np.full(-n % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - w + 1], left[w - 1 : n])
    return (least[np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))] & low).astype(np.int64)


def fingerprints(df: DataFrame, span: int) -> DataFrame:
    """(h bigint, id, at int) of (id, text): the kept windows of each text of ``span`` code points or more. A window
    that a text repeats more than ``REPEATS`` times (a rule of dashes, say) stands once, with a place of -1: such a
    text is later compared window by window."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = _Powers()
        for part in parts:
            out = []
            for key, text in zip(part["id"], part["text"]):
                h = window_hashes(text, WINDOW, powers)
                at = winnow(h, span - WINDOW + 1)
                values, first, counts = np.unique(h[at], return_index=True, return_counts=True)
                often = values[counts > REPEATS]
                if len(often):
                    at = at[~np.isin(h[at], often)]
                    values = np.concatenate([h[at], often])
                    at = np.concatenate([at, np.full(len(often), -1)])
                else:
                    values = h[at]
                out.append(pd.DataFrame({"h": values.view(np.int64), "id": key, "at": at.astype(np.int32)}))
            if out:
                yield pd.concat(out)

    long = df.where(F.length("text") >= span)
    return long.mapInPandas(run, f"h bigint, id {dict(df.dtypes)['id']}, at int")


def _same(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, step = 0, 64
    while a[low : low + step] == b[low : low + step]:
        low, step = low + step, step * 2
    high = min(n, low + step)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _cover(at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` of windows of ``k``, in order, so many that their windows cover what all of them cover."""
    kept, i = [], 0
    while i < len(at):
        kept.append(int(at[i]))
        # The last that still touches this one, or the next after a gap.
        i = max(int(np.searchsorted(at, at[i] + k, "right")) - 1, i + 1)
    return np.array(kept, np.int64)


def _common_windows(a: str, b: str, k: int) -> list[tuple[int, int]]:
    """Places of windows of ``k`` code points that both have, each with the first place in the other: on either side the
    windows cover all that the common windows cover."""
    powers = _Powers()
    x, y = (window_hashes(t, k, powers) for t in (a, b))
    (u, i), (v, j) = (np.unique(h, return_index=True) for h in (x, y))
    in_a, in_b = _cover(np.flatnonzero(np.isin(x, v)), k), _cover(np.flatnonzero(np.isin(y, u)), k)
    pairs = list(zip(in_a.tolist(), j[np.searchsorted(v, x[in_a])].tolist()))
    return pairs + list(zip(i[np.searchsorted(u, y[in_b])].tolist(), in_b.tolist()))


def grow(a: str, b: str, places: list[tuple[int, int]], span: int) -> list[tuple[int, int, int]]:
    """(start in a, start in b, length) of the common spans of ``span`` or more that hold one of the places. They cover
    every place of either text that stands in the other, not every pair of places where one of them is -1."""
    found: list[tuple[int, int, int]] = []
    ends: dict[int, int] = {}
    if any(min(p) < 0 for p in places):
        places = [p for p in places if min(p) >= 0] + _common_windows(a, b, span)
    for i, j in sorted(places):
        if i < ends.get(i - j, -1) or a[i : i + WINDOW] != b[j : j + WINDOW]:
            continue
        most, least = min(len(a) - i, len(b) - j), min(i, j)
        right = _same(a[i : i + most], b[j : j + most])
        left = _same(a[i - least : i][::-1], b[j - least : j][::-1])
        ends[i - j] = i + right
        if left + right >= span:
            found.append((i - left, j - left, left + right))
    return found


class SpanIndex:
    """Fingerprint runs in the shared folder. ``add`` matches a batch with all before it and takes it in."""

    def __init__(self, spark: SparkSession, texts: Callable[[], DataFrame], span: int = 200) -> None:
        """``texts``: gives (id, text) of every row ever added, to verify matches."""
        if span <= WINDOW:
            raise ValueError(f"span must exceed {WINDOW}")
        self.spark, self.texts, self.span = spark, texts, span
        self.runs: list[tuple[int, str]] = []

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.parquet(path)

    def _write(self, df: DataFrame) -> str:
        path = fresh_path(self.spark, "run")
        df.repartition("h").sortWithinPartitions("h").write.parquet(path)
        return path

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of (id, text) whose ids are new; its common spans with history and within itself:
        (a, b, start_a, start_b, length), a < b, all of full length."""
        return self.verified(self.places(fingerprints(batch, self.span)))

    def places(self, marks: DataFrame) -> DataFrame:
        """Take in a batch's fingerprints; (a, b, places): where they meet those of history and each other. Not
        verified yet, so that the texts can be read once for several batches."""
        path = self._write(marks)
        new = self._read(path).select("h", F.col("id").alias("x"), F.col("at").alias("x_at"))
        old = new.select("h", F.col("x").alias("y"), F.col("x_at").alias("y_at"), F.lit(True).alias("own"))
        for _, p in self.runs:
            old = old.unionByName(self._read(p).select("h", F.col("id").alias("y"), F.col("at").alias("y_at"), F.lit(False).alias("own")))
        pairs = new.join(old.hint("merge"), "h").where((F.col("x") != F.col("y")) & (~F.col("own") | (F.col("x") < F.col("y"))))
        first = F.col("x") < F.col("y")
        met = pairs.select(
            F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"),
            F.struct(F.when(first, F.col("x_at")).otherwise(F.col("y_at")).alias("i"), F.when(first, F.col("y_at")).otherwise(F.col("x_at")).alias("j")).alias("at"),
        ).groupBy("a", "b").agg(F.collect_set("at").alias("places"))
        self.runs.append((0, path))
        self._compact()
        return materialize(met, "places")

    def _compact(self) -> None:
        for level in range(64):
            same = [p for k, p in self.runs if k == level]
            if len(same) < FANOUT:
                return
            merged = self._write(self.spark.read.parquet(*same))
            self.runs = [(k, p) for k, p in self.runs if k != level] + [(level + 1, merged)]

    def verified(self, places: DataFrame) -> DataFrame:
        span, kind = self.span, dict(places.dtypes)["a"]

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                rows = [
                    (a, b, *hit)
                    for a, b, at, x, y in zip(part["a"], part["b"], part["places"], part["x"], part["y"])
                    for hit in grow(x, y, [(p["i"], p["j"]) for p in at], span)
                ]
                yield pd.DataFrame(rows, columns=["a", "b", "start_a", "start_b", "length"])

        # Only texts that are in a pair move.
        ids = places.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        texts = materialize(self.texts().join(ids, "id", "left_semi"), "texts")
        both = places.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
        return both.mapInPandas(run, f"a {kind}, b {kind}, start_a int, start_b int, length int")


def text_classes(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(id, first): each row of a text of ``least`` code points or more with the smallest id of rows with the very same
    text. Compared by a 256-bit digest."""
    long = df.where(F.length(text) >= least).select(F.col(key).alias("id"), F.sha2(text, 256).alias("_d"))
    firsts = long.groupBy("_d").agg(F.min("id").alias("first"))
    return long.join(firsts, "_d").select("id", "first")


def shared_spans(df: DataFrame, key: str, text: str, batch: Column, batches: int, span: int = 200) -> tuple[DataFrame, DataFrame]:
    """The common spans of all rows, by taking the batches into an index one after the other.

    Rows with the very same text are one entry of the index; ``members`` tells which.

    :param batch: an integer expression from 0 to ``batches`` - 1: which batch a row arrives in.
    :return: spans (a, b, start_a, start_b, length) between the entries, and members (id, first). Null and short texts
        have neither.
    """
    spark = df.sparkSession
    members = materialize(text_classes(df, key, text, span), "members")
    rows = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    # Copies are left out by their marks, which are a fraction of the texts.
    copies = members.where("id <> first").select("id")
    index = SpanIndex(spark, lambda: rows, span)
    met = None
    for n in range(batches):
        marks = fingerprints(df.where(batch == n).select(F.col(key).alias("id"), F.col(text).alias("text")), span)
        places = index.places(marks.join(copies, "id", "left_anti"))
        met = places if met is None else met.unionByName(places)
    return materialize(index.verified(met), "spans"), members


def shared_pairs(spans: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of rows with a common span, rows of the same text included."""
    linked = spans.select("a", "b").distinct()
    left, right = members.select(F.col("first").alias("a"), F.col("id").alias("p")), members.select(F.col("first").alias("b"), F.col("id").alias("q"))
    across = linked.join(left, "a").join(right, "b").select("p", "q")
    within = left.join(right.withColumnRenamed("b", "a"), "a").where("p < q").select("p", "q")
    both = across.unionByName(within)
    return both.select(F.least("p", "q").alias("doc_a"), F.greatest("p", "q").alias("doc_b"))


def shared_extent(df: DataFrame, key: str, text: str, spans: DataFrame, members: DataFrame) -> DataFrame:
    """(key, n_chars, shared_chars): of each row, how many code points stand in a span that another row has too. Null
    texts have 0 of 0."""
    each = spans.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("start_a").alias("s"), F.col("length").alias("n")), F.struct(F.col("b").alias("id"), F.col("start_b").alias("s"), F.col("length").alias("n")))).alias("x")).select("x.*")
    # A row's spans, at most some per partner, are merged in order of their start: each adds what lies past the end so far.
    merged = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("n")).alias("e")))),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["n"] + F.greatest(x["e"] - F.greatest(acc["end"], x["s"]), F.lit(0))).alias("n")),
        lambda acc: acc["n"],
    )
    cover = each.groupBy("id").agg(merged.alias("cover")).select(F.col("id").alias("first"), "cover")
    copies = members.groupBy("first").agg(F.count(F.lit(1)).alias("copies"))
    rows = members.join(copies, "first").join(cover, "first", "left").select(F.col("id").alias(key), "copies", "cover")
    n = F.coalesce(F.length("_text"), F.lit(0))
    shared = F.when(F.col("copies") > 1, n).otherwise(F.coalesce("cover", F.lit(0)))
    return df.select(key, F.col(text).alias("_text")).join(rows, key, "left").select(key, n.alias("n_chars"), shared.alias("shared_chars"))
