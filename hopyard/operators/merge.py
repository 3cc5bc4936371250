"""Records from a curated table, a fresh extract and what was published before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopyard.operators.quality import filled


def first_filled(columns: list[Column], kind: str) -> Column:
    """The first that isn't null or empty; else an empty text or list."""
    empty = F.array().cast(kind) if kind.startswith("array") else F.lit("") if kind == "string" else F.lit(None).cast(kind)
    return F.coalesce(*[F.when(filled(c, kind), c) for c in columns], empty)


def keep_previous(config: DataFrame, extract: DataFrame, previous: DataFrame, id_: str, owned: list[str], runtime: list[str], ok: Column | None = None) -> DataFrame:
    """One record for each config row: an owned field is config's, or where that is empty the previous one; a runtime
    field is the extract's, or where that is empty the previous one.

    :param extract: (id, *runtime); ``previous``: (id, *owned, *runtime). At most one row for each id.
    :param ok: a condition on the extract, named by its columns; where it fails, its first runtime field doesn't count
        (hours that can't be read), the others do.
    """
    kinds = dict(previous.dtypes)
    if ok is not None:
        extract = extract.withColumn(runtime[0], F.when(ok, F.col(runtime[0])))
    e = extract.select(id_, *[F.col(f).alias(f"_e_{f}") for f in runtime])
    p = previous.select(id_, *[F.col(f).alias(f"_p_{f}") for f in (*owned, *runtime)])
    rows = config.select(id_, *owned).join(e, id_, "left").join(p, id_, "left")
    of = lambda f, *sides: first_filled([F.col(f"_{s}_{f}") if s else F.col(f) for s in sides], kinds[f]).alias(f)
    return rows.select(id_, *[of(f, "", "p") for f in owned], *[of(f, "e", "p") for f in runtime])


def overlay(results: DataFrame, previous: DataFrame, id_: str) -> DataFrame:
    """Results, and the previous rows of ids that the run didn't touch."""
    return results.unionByName(previous.join(results.select(id_), id_, "left_anti"))


def unchanged(cache: DataFrame, fresh: DataFrame, id_: str, usable: Column) -> DataFrame:
    """(id) of fresh rows (id, content_hash) whose text the cache (id, content_hash, ...) holds with a usable extract: these
    need no work. Rows without an id or hash always do."""
    return fresh.select(id_, "content_hash").join(cache.where(usable).select(id_, "content_hash").distinct(), [id_, "content_hash"], "left_semi").select(id_).distinct()


def weekly_text(df: DataFrame, id_: str, day: str, hours: str) -> DataFrame:
    """(id, weekly): "Mon-Wed 11am-10pm, Fri 9am-5pm" of rows (id, day 1 to 7, hours), equal days in a run joined. A day
    given twice has its greatest text; days without a text are left out."""
    days = F.map_from_entries(F.collect_set(F.struct("_d", "_h")))
    by_day = df.where(F.coalesce(F.trim(hours), F.lit("")) != "").groupBy(F.col(id_), F.col(day).alias("_d")).agg(F.max(F.trim(hours)).alias("_h"))
    week = by_day.groupBy(id_).agg(days.alias("_m"))
    name = lambda i: F.get(F.array(*[F.lit(x) for x in ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")]), i.cast("int") - 1)
    seven = lambda: F.sequence(F.lit(1), F.lit(7))
    at = lambda i: F.try_element_at(F.col("_m"), i.cast(dict(df.dtypes)[day]))
    starts = F.filter(seven(), lambda i: at(i).isNotNull() & ~at(i).eqNullSafe(at(i - 1)))
    end = lambda i: F.coalesce(F.array_min(F.filter(seven(), lambda j: (j > i) & ~at(j).eqNullSafe(at(i)))), F.lit(8)) - 1
    text = F.transform(starts, lambda i: F.concat(name(i), F.when(end(i) > i, F.concat(F.lit("-"), name(end(i)))).otherwise(""), F.lit(" "), at(i)))
    return week.select(id_, F.array_join(text, ", ").alias("weekly"))
