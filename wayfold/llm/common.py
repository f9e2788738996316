"""What the corpus operators share: tables kept between steps, column picking, byte helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word separators of the contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset (tests on one
    machine) is a temporary folder made and remembered in the session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("wayfold.shared.dir", None) or "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.conf.set("wayfold.shared.dir", folder)
    return folder.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    It cuts the lineage, survives the loss of executors, and computes its input once (a checkpoint without a cache
    computes it twice). The table goes when the session's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/wayfold-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id: Column | str, folds: int = 5) -> Column:
    """True where crc32(doc_id as text) mod ``folds`` is 0; a null id counts as the text ''."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(folds) == 0


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(rows: DataFrame, key: str, n: int, *ties: str) -> DataFrame:
    """At most ``n`` rows: those whose hashed ``key`` (column ``h``), as a number without a sign, is smallest, ordered by
    it and then by ``ties``.

    A first pass, which reads the key alone, counts the hashes by their number of bits. The second one takes those of so
    many bits as hold n rows, about 2 n at most, so that what the tasks hand on for the final order does not grow with
    their number (many rows of one key may, by n rows a task).
    """
    hashed = rows.withColumn("h", F.xxhash64(key))
    bits = F.length(F.bin("h"))  # 64 for a negative number
    upto, least = 0, 64
    for b, count in sorted(tuple(r) for r in hashed.groupBy(bits.alias("b")).count().collect()):  # 64 rows
        upto += count
        if upto >= n:
            least = b
            break
    some = hashed.where(F.shiftrightunsigned("h", least) == 0) if least < 64 else hashed
    return some.orderBy(bits, "h", *ties).limit(n)
