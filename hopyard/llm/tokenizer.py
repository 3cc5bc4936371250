"""Byte-level BPE encoding with Spark's higher-order functions.

A text is split into words by the tokenizer's pattern. A word that is itself a token gets its id from a literal rank
map in the scan. The other words are reduced to the distinct ones over the whole corpus; each of these is encoded once
by folding ranked merges over its bytes, and the result is joined back to the words' places.

In the fold a byte is held as the character of the same number (ISO 8859-1), so that a byte array is a string on which
Spark's string functions work, and the rank map has such strings as keys. In the scan words stand as they are, and the
rank map has the tokens that are texts.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopyard.session import materialize

#: The words of the byte-level tokenizers: contractions, letters, digits or other characters with one leading space,
#: white space. (?U): white space as Unicode has it. Possessive, as no alternative ever has to give a character back
#: but white space before a word.
PATTERN = r"(?U) ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"

BUCKETS = 8192
NO_RANK = 2**31 - 1
#: Stand around the pieces of a word; no byte has these characters.
LEFT, RIGHT = "‹", "›"
#: Bytes from which on a word is folded by pairs instead of places.
LONG = 128
#: Above every place in a word that is folded by places.
PLACES = 256


@lru_cache(maxsize=4)
def _ranks(path: str) -> tuple[tuple[str, int], ...]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return tuple((base64.b64decode(token).decode("latin-1"), int(rank)) for token, rank in pairs)


@lru_cache(maxsize=4)
def _rank_json(path: str, texts: bool = False) -> str:
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in _ranks(path):
        if texts:
            try:
                token = token.encode("latin-1").decode()
            except UnicodeDecodeError:
                continue  # part of a character, which no word is
        buckets[zlib.crc32(token.encode()) % BUCKETS][token] = rank
    return json.dumps(buckets)


@lru_cache(maxsize=4)
def _piece_json(path: str) -> str:
    pieces = [""] * (max((r for _, r in _ranks(path)), default=-1) + 1)
    for token, rank in _ranks(path):
        pieces[rank] = token
    return json.dumps(pieces)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_ranks(path: str, use: Callable[[Callable[[Column], Column]], Column], texts: bool = False) -> Column:
    """``use`` applied to a lookup of a byte string's rank, or with ``texts`` a text's (null if it has none).

    The map is a literal: an array of small maps, one of which is chosen by checksum, as Spark searches a map from end
    to end. The optimizer folds the JSON into the literal, which stands once in the expression however often it is
    looked up, as every task reads it anew.
    """
    buckets = F.from_json(F.lit(_rank_json(path, texts)), "array<map<string,int>>")
    return _let(buckets, lambda m: use(lambda s: F.try_element_at(F.get(m, F.pmod(F.crc32(s), F.lit(BUCKETS)).cast("int")), s)))


def as_bytes(word: Column) -> Column:
    """The UTF-8 bytes of a string as characters of the same numbers; ASCII needs no conversion."""
    return F.when(F.length(word) == F.octet_length(word), word).otherwise(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"))


def words(text: Column) -> Column:
    """The words of a text by the tokenizer's pattern; an empty array for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def fold_places(word: Column, rank: Callable[[Column], Column]) -> Column:
    """The pieces of a byte string: a fold in which each round merges the leftmost pair of the lowest rank, keeping
    the ranks of all pairs so that a round looks up only the two pairs it makes. Time grows as length x rounds.

    Pieces are held as the places where they start, and cut from the word where they are looked up. ``at`` has them from
    its second element on, then the word's end; its first and last element, with which any cut is empty, stand for the
    neighbours that the outer pieces lack. ``r`` has, between two nulls, a pair's rank x PLACES + the place of its first
    piece, where ``at`` has that piece; counting what starts up to there finds it.
    """

    def cut(start: Column, end: Column) -> Column:
        return F.substr(word, start, end - start)

    def pair(start: Column, end: Column) -> Column:
        return rank(cut(start, end)) * PLACES + start

    def merge(at: Column, r: Column, i: Column) -> Column:
        left, right = pair(F.get(at, i - 2), F.get(at, i + 1)), pair(F.get(at, i - 1), F.get(at, i + 2))
        return F.struct(
            F.concat(F.slice(at, F.lit(1), i), F.slice(at, i + 2, F.size(at))).alias("at"),
            F.concat(F.slice(r, F.lit(1), i - 2), F.array(left, right), F.slice(r, i + 2, F.size(r))).alias("r"),
        )

    n = F.length(word)
    none = F.array(F.lit(None).cast("int"))
    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: pair(i, i + 2))).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.concat(F.array(n + 2), F.sequence(F.lit(1), n + 1), F.array(F.lit(0))).alias("at"), F.concat(none, pairs, none).alias("r"))
    step = lambda state, _: _let(F.array_min(state["r"]), lambda m: F.when(m.isNull(), state).otherwise(_let(F.size(F.filter(state["at"], lambda x: x <= m % PLACES)), lambda i: merge(state["at"], state["r"], i))))
    pieces = lambda at: F.transform(F.slice(at, F.lit(2), F.size(at) - 3), lambda s, i: cut(s, F.get(at, i + 2)))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step, lambda state: pieces(state["at"]))


def fold_pairs(word: Column, rank: Callable[[Column], Column]) -> Column:
    """The pieces of a byte string: a fold in which each round merges the pair of the lowest rank wherever it occurs,
    from the left. For long words, as its rounds are bounded by the different merges. Each piece stands in a string
    between two marks of its own, so that neighbouring pairs share none."""

    def pieces(marked: Column) -> Column:
        return F.split(F.substring(marked, F.lit(2), F.length(marked) - 2), RIGHT + LEFT)

    def lowest(p: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(p) - 2)
        return F.array_min(F.transform(at, lambda i: F.struct(F.coalesce(rank(F.concat(F.get(p, i), F.get(p, i + 1))), F.lit(NO_RANK)).alias("rank"), i.alias("at"))))

    def ended(marked: Column) -> Column:
        return F.struct(marked.alias("marked"), F.lit(True).alias("done"))

    def merge(marked: Column, p: Column, m: Column) -> Column:
        a, b = F.get(p, m["at"]), F.get(p, m["at"] + 1)
        pair, one = F.concat(F.lit(LEFT), a, F.lit(RIGHT + LEFT), b, F.lit(RIGHT)), F.concat(F.lit(LEFT), a, b, F.lit(RIGHT))
        return F.when(m["rank"] == NO_RANK, ended(marked)).otherwise(F.struct(F.replace(marked, pair, one).alias("marked"), F.lit(False).alias("done")))

    def step(state: Column, _: Column) -> Column:
        marked = state["marked"]
        more = _let(pieces(marked), lambda p: F.when(F.size(p) < 2, ended(marked)).otherwise(_let(lowest(p), lambda m: merge(marked, p, m))))
        return F.when(state["done"], state).otherwise(more)

    start = F.concat(F.lit(LEFT), F.array_join(F.split(word, ""), RIGHT + LEFT), F.lit(RIGHT))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(word)), F.struct(start.alias("marked"), F.lit(False).alias("done")), step, lambda state: pieces(state["marked"])
    )


def fold_merges(word: Column, rank: Callable[[Column], Column]) -> Column:
    """The ids of one byte string of one byte or more."""
    folded = F.when(F.length(word) > LONG, fold_pairs(word, rank)).otherwise(fold_places(word, rank))
    return F.transform(folded, rank)


def _split(df: DataFrame, key: str, text: str, ranks: str, ids: bool = True) -> DataFrame:
    """(_key, known, open): ``open`` has the distinct words of a text that are no tokens; ``known`` the id of each word,
    for one of these -1 for the first of them, -2 for the second and so on. Without ``ids``, ``known`` is only the number
    of words, and ``open`` has a word as often as it occurs.

    The split is written once, as several steps read it, and each would run it again; what they read is a fraction of
    the texts.
    """

    def counted(w: Column, rank: Callable[[Column], Column]) -> Column:
        return F.struct(F.size(w).alias("known"), F.filter(w, lambda x: rank(x).isNull()).alias("open"))

    def named(w: Column, known: Column) -> Column:
        # A map from word to number, built once for a text.
        numbers = lambda open_: F.map_from_arrays(open_, F.transform(open_, lambda _, i: -1 - i))
        filled = lambda m: F.transform(known, lambda k, i: F.coalesce(k, F.try_element_at(m, F.get(w, i))))
        rest = F.array_distinct(F.filter(w, lambda _, i: F.get(known, i).isNull()))
        return _let(rest, lambda open_: F.struct(_let(numbers(open_), filled).alias("known"), open_.alias("open")))

    def parts(w: Column, rank: Callable[[Column], Column]) -> Column:
        return _let(F.transform(w, rank), lambda known: named(w, known)) if ids else counted(w, rank)

    # The struct's fields are taken from the table read back, not here, where each would split the text again.
    row = materialize(df.select(F.col(key).alias("_key"), with_ranks(ranks, lambda rank: _let(words(F.col(text)), lambda w: parts(w, rank)), texts=True).alias("_s")), "split")
    return row.select("_key", F.col("_s.known").alias("known"), F.col("_s.open").alias("open"))


def _encoded_words(places: DataFrame, ranks: str) -> DataFrame:
    """Each distinct open word with its ids. Duplicates are dropped before the shuffle, so a frequent word is one row
    per task there."""
    return materialize(places.select("_word").distinct().withColumn("_piece_ids", with_ranks(ranks, lambda rank: _let(as_bytes(F.col("_word")), lambda b: fold_merges(b, rank)))), "pieces")


def encode(df: DataFrame, key: str, text: str, ranks: str) -> DataFrame:
    """The token ids of each row's text.

    :param key: a unique column. ``text``: a string column. ``ranks``: path of a file of ranked tokens (base64, rank).
    :return: (key, ids array<int>), one row for each row of ``df``; ``ids`` is empty for a null or empty text. Other
        columns of ``df`` play no part, whatever their names. Keys must not be null or repeated.
    """
    base = _split(df, key, text, ranks)
    places = base.select("_key", F.posexplode("open").alias("_at", "_word"))
    filled = places.join(_encoded_words(places, ranks), "_word").select("_key", (F.col("_at") + 1).alias("_at"), F.col("_piece_ids").alias("_ids"))
    # A text's known ids and its filled words meet in one exchange, as rows and not as partial lists: hardly any key
    # comes twice in a task before it.
    whole = base.select("_key", F.lit(0).alias("_at"), F.col("known").alias("_ids"))
    rows = whole.unionByName(filled).repartition("_key").groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_at", "_ids")))["_ids"].alias("_x"))

    def assembled(x: Column) -> Column:
        known = F.get(x, F.lit(0))
        return F.when(F.size(x) == 1, known).otherwise(F.flatten(F.transform(known, lambda k: F.when(k >= 0, F.array(k)).otherwise(F.get(x, -k)))))

    return rows.select(F.col("_key").alias(key), _let(F.col("_x"), assembled).alias("ids"))


def count_tokens(df: DataFrame, key: str, text: str, ranks: str) -> DataFrame:
    """The number of tokens of each row's text: (key, n_tokens bigint); 0 for a null or empty text. As ``encode``, but
    only counts move."""
    base = _split(df, key, text, ranks, ids=False)
    places = base.select("_key", F.explode("open").alias("_word"))
    more = places.join(_encoded_words(places, ranks).select("_word", F.size("_piece_ids").alias("_n")), "_word").select("_key", (F.col("_n") - 1).cast("bigint").alias("_n"))
    return base.select("_key", F.col("known").cast("bigint").alias("_n")).unionByName(more).groupBy("_key").agg(F.sum("_n").alias("n_tokens")).withColumnRenamed("_key", key)


def decode(ids: Column, ranks: str) -> Column:
    """The text of an array of ids: their byte pieces concatenated, read as UTF-8. Null for null; unknown ids are
    passed over."""
    pieces = F.from_json(F.lit(_piece_json(ranks)), "array<string>")
    joined = F.array_join(F.transform(ids, lambda i: F.coalesce(F.get(pieces, i), F.lit(""))), "")
    return F.decode(F.encode(joined, "ISO-8859-1"), "UTF-8")
