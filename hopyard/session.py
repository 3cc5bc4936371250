"""Session settings and the shared scratch folder.

Intermediate tables go to the folder that the cluster names in ``spark.checkpoint.dir``; a folder of our own is made
only where that setting is absent and all runs on one machine (tests, a laptop). Nothing is kept on one executor alone, so that a lost executor
costs a recomputation, never a result.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

_own: str | None = None


def get_session(app: str = "hopyard", **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword arguments (dots as double underscores) override them."""
    settings = SETTINGS | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        folder = tempfile.TemporaryDirectory(prefix="hopyard-")
        atexit.register(folder.cleanup)
        _own = folder.name
    return _own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{scratch(spark)}/hopyard/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and computes it a single time.

    Preferred to ``checkpoint()``, which runs the plan twice and stores rows uncompressed.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that no later step reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the project's tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
