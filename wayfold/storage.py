"""Tables kept between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset (tests on one machine)
    is a temporary folder made and remembered in the session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("wayfold.tables.dir", None) or "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("wayfold.tables.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder that is removed when the session's JVM ends."""
    path = f"{folder(spark)}/wayfold-{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet and reads it back: the lineage is cut, and a lost executor costs its own tasks only."""
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
