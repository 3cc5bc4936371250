"""Readers of the formats the records come in."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON documents. Tolerant: a document that can't be read has nulls; strict: it raises."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


_POI = {"names": "struct<primary:string>", "addresses": "array<struct<freeform:string,locality:string>>", "phones": "array<string>", "categories": "struct<primary:string>"}


def poi(raw: DataFrame) -> DataFrame:
    """Points of interest from the nested layout (names, addresses, phones, categories), each nested or as a JSON text: the
    first address with its town unless it holds it, texts empty, status open and confidence 0 where they are missing. A
    name that is a plain text is the name; other texts that can't be read count as missing."""
    kinds, empty = dict(raw.dtypes), F.lit("")
    part = lambda c: F.from_json(c, _POI[c]) if kinds[c] == "string" else F.col(c)
    name = part("names")["primary"]
    if kinds["names"] == "string":
        name = F.when(F.trim("names").startswith("{"), name).otherwise(F.col("names"))
    first = F.get(part("addresses"), F.lit(0))
    free, town = F.coalesce(first["freeform"], empty), F.coalesce(first["locality"], empty)
    address = F.when((town == "") | F.contains(free, town), free).when(free == "", town).otherwise(F.concat_ws(", ", free, town))
    phone = F.coalesce(F.get(part("phones"), F.lit(0)), empty)
    status = F.coalesce(F.nullif("operating_status", empty), F.lit("open"))
    return raw.select("id", F.coalesce(name, empty).alias("name"), address.alias("address"), phone.alias("phone"), status.alias("operating_status"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), part("categories")["primary"].alias("category"))


#: Parts of the categories that a bounding-box query keeps.
CATEGORIES = ("restaurant", "bar", "cafe", "pub", "brewery", "food")


def in_categories(category: Column, parts: tuple[str, ...] = CATEGORIES) -> Column:
    """Whether a category holds one of the parts, whatever the case."""
    return F.coalesce(functools.reduce(lambda a, b: a | b, [category.ilike(f"%{p}%") for p in parts]), F.lit(False))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a bounding box; pushed down to the scan as four comparisons."""
    return lat.between(south, north) & lon.between(west, east)


def salvage_json(text: Column) -> Column:
    """The JSON in a text around it: a fenced block, else the outermost braces; null for none."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    return F.coalesce(fenced, F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")))


def locations(xml: Column) -> Column:
    """The addresses in a sitemap, in order; an empty array for null and for other texts."""
    return F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?s)<loc>\s*(.*?)\s*</loc>"), F.lit(1))


def read_cache(spark: SparkSession, path: str, extract: str) -> DataFrame:
    """(id, content_hash, fetched_at, sources, extract) of a cache in either shape: a map of entries under ``venues``, or the
    map itself, of which only entries with a ``content_hash`` count.

    :param extract: the type of an entry's extract.
    """
    entry = f"struct<content_hash:string,fetched_at:string,sources:array<string>,extract:{extract}>"
    whole = spark.read.text(path, wholetext=True)
    inner = F.from_json("value", f"venues map<string,{entry}>")["venues"]
    # The flat map is read as texts first: its other members needn't be entries.
    flat = F.transform_values(F.map_filter(F.from_json("value", "map<string,string>"), lambda _, v: v.startswith("{")), lambda _, v: F.from_json(v, entry))
    rows = whole.select(F.explode(F.when(inner.isNotNull(), inner).otherwise(F.map_filter(flat, lambda _, v: v["content_hash"].isNotNull()))).alias("id", "e"))
    return rows.select("id", "e.*")


def save_text(spark: SparkSession, path: str, content: str) -> None:
    """Write one small text (a report, a state) whole or not at all: into a file beside it, which then takes its place."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    beside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:12]}.tmp")
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(beside, True)
        out.write(bytearray(content.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
        over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(files.makeQualified(beside), files.makeQualified(target), over)
    except BaseException:
        files.delete(beside, False)
        raise


def save_json(spark: SparkSession, path: str, value: object) -> None:
    """One small JSON document, indented, letters as they are."""
    save_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False) + "\n")


def append_observations(df: DataFrame, root: str) -> None:
    """Add rows to a store of one folder for each venue_id. A venue with very many rows is spread over several files."""
    df.write.mode("append").partitionBy("venue_id").json(root)


def observations_of(spark: SparkSession, root: str, schema: StructType | str, venue: str | None = None) -> DataFrame:
    """The store's rows, of one venue only that venue's folder; rows that can't be read are left out."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(root)
    return rows if venue is None else rows.where(F.col("venue_id") == venue)
