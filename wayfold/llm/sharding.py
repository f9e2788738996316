"""Shards along a Hilbert curve over several metadata dimensions.

Each dimension is quantised by its own quantiles (approximate, from a mergeable summary), the cells are ordered along
the curve, and the order is cut into runs of equal row counts. Rows near in every dimension lie in the same or a
neighbouring shard, so a filter on any of them meets few files (`shard_stats`).

Scale: one shuffle, by ranges of (curve index, tie breakers). The tie breakers split a cell that holds many rows, so a
hot source does not make a hot range. A row's place is its range's offset plus its place in the range; only the row
counts of the ranges go to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import fresh, keep, parts

SHARDS, BITS, OVERHEAD = 40, 6, 16
#: Relative precision of the quantiles.
PRECISION = 2_000


def hilbert_index(codes: np.ndarray, bits: int) -> np.ndarray:
    """Place along the curve of points with integer coordinates (d, n) under 2**bits; d * bits at most 62.

    From the highest bit down, each axis either mirrors the first one or swaps with it, which undoes the turns of the
    curve; a Gray code over the axes and bits then gives the place.
    """
    x = [c.astype(np.uint64) for c in codes]
    d, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        low = np.uint64((1 << b) - 1)
        for i in range(d):
            mirror = (x[i] >> np.uint64(b)) & one == 1
            swap = np.where(mirror, np.uint64(0), (x[0] ^ x[i]) & low)
            if i:
                x[i] = x[i] ^ swap
            x[0] = x[0] ^ np.where(mirror, low, swap)
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(b)) & one == 1, flip ^ np.uint64((1 << b) - 1), flip)
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            out = (out << one) | (((x[i] ^ flip) >> np.uint64(b)) & one)
    return out.astype(np.int64)


def leading_number(text: Column, skip: int = 0) -> Column:
    """Six bytes of a string, after ``skip`` bytes, as a number, which orders strings that share those bytes as they do;
    null stays null."""
    head = F.substring(F.encode(text, "UTF-8"), skip + 1, 6)
    return F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double")


def _numeric(df: DataFrame, dims: list[str]) -> list[Column]:
    """Each dimension as a number; strings by the six bytes behind what all of them begin with."""
    kinds = dict(df.dtypes)
    texts = [d for d in dims if kinds[d] == "string"]
    ends = df.agg(*(f(d).alias(f"{n}{k}") for k, d in enumerate(texts) for n, f in (("a", F.min), ("z", F.max)))).first() if texts else None
    skip = {}
    for k, d in enumerate(texts):
        a, z = ((ends[f"{n}{k}"] or "").encode("utf-8", "surrogatepass") for n in "az")
        skip[d] = next((i for i, (x, y) in enumerate(zip(a, z, strict=False)) if x != y), min(len(a), len(z)))
    return [leading_number(F.col(d), skip[d]) if d in skip else F.col(d).cast("double") for d in dims]


def hilbert_order(df: DataFrame, dims: list[str], ties: list[str], rank: str = "rank", bits: int = BITS) -> DataFrame:
    """``df`` with the place of each row (long, from 0, without gaps) along the curve over the columns ``dims``.

    Null and NaN come first in a dimension. Rows of a cell are ordered by ``dims`` as they are and then by ``ties``; rows equal in all of these come in
    any order, but each has one place. The kept table is sorted, in ranges.
    """
    spark, columns = df.sparkSession, df.columns
    marks = fresh(df, *(f"dim_{k}" for k in range(len(dims))), "curve", "mid", "part", "before", rank)
    values, (curve, mid, part, before, _) = marks[: len(dims)], marks[len(dims) :]
    df = df.withColumns({v: F.nanvl(c, F.lit(None).cast("double")) for v, c in zip(values, _numeric(df, dims), strict=True)})
    steps = (1 << bits) - 2
    shares = [k / steps for k in range(1, steps)]
    found = df.agg(*(F.percentile_approx(v, shares, PRECISION).alias(v) for v in values)).first()
    bounds = [np.unique(np.array(found[v] or [], dtype=float)) for v in values]

    @F.pandas_udf("long")
    def place(frame: pd.DataFrame) -> pd.Series:
        codes = []
        for k, b in enumerate(bounds):
            x = frame.iloc[:, k].to_numpy(dtype=float)
            codes.append(np.where(np.isnan(x), 0, 1 + np.searchsorted(b, x, side="right")))
        return pd.Series(hilbert_index(np.array(codes), bits))

    placed = df.withColumn(curve, place(F.struct(*values))).drop(*values)
    ranged = placed.repartitionByRange(parts(spark), curve, *dims, *ties).sortWithinPartitions(curve, *dims, *ties)
    kept = keep(ranged.withColumn(mid, F.monotonically_increasing_id()))
    kept = kept.withColumn(part, F.shiftrightunsigned(mid, 33))
    counts = sorted((r[0], r[1]) for r in kept.groupBy(part).count().collect())  # a row per range
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    offsets = spark.createDataFrame(starts or [(0, 0)], f"`{part}` long, `{before}` long")
    joined = kept.join(F.broadcast(offsets), part)
    return joined.select(*columns, (F.col(before) + F.col(mid).bitwiseAND(F.lit((1 << 33) - 1))).alias(rank))


def cut_runs(ordered: DataFrame, shards: int = SHARDS, rank: str = "rank") -> DataFrame:
    """Cuts an order into ``shards`` runs whose row counts are at most one apart: shard (int) and slot (long) instead
    of the rank. With fewer rows than shards some shards stay empty."""
    total = ordered.count()
    exact = F.expr(f"`{rank}` * {shards} div {max(total, 1)}")
    first = F.expr(f"((`{rank}` * {shards} div {max(total, 1)}) * {total} + {shards - 1}) div {shards}")
    return ordered.select(*(c for c in ordered.columns if c != rank), exact.cast("int").alias("shard"), (F.col(rank) - first).alias("slot"))


def hilbert_shards(df: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All rows and columns of ``df`` with shard and slot, which ``df`` must not have."""
    if taken := {"shard", "slot"} & {c.lower() for c in df.columns}:
        raise ValueError(f"the table has columns named {sorted(taken)}")
    return cut_runs(hilbert_order(df, dims, ties, *fresh(df, "rank"), bits), shards, *fresh(df, "rank"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows by slot."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_stats(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Least and largest value of each dimension by shard: what a reader prunes files by."""
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *(f(d).alias(f"{n}_{d}") for d in dims for n, f in (("min", F.min), ("max", F.max))))


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``documents`` (doc_id, text, lang, source).

    The law is ``rows``: the shards' row counts are at most one apart. The curve runs over language, source and size;
    equal texts of a language and source are neighbours, those of different ones may lie apart. A null text has no bytes and the CRC of none; null languages
    and sources come first; repeated rows get a slot each; other columns are ignored; no rows give none.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "lang",
        "source",
    )
    sharded = hilbert_shards(keep(thin), ["lang", "source", "size"], ["text_crc32", "doc_id"], shards)
    return sharded.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
