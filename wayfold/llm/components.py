"""Connected components of links, by alternating large and small stars over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import keep


def _print(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges (as good as surely, for others different)."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v: long), root being the smallest node of its component (which has
    a row of its own only as another's root). Links may repeat, in either direction; a node linked to itself alone has
    no row.

    A round links each node's larger neighbours to the smallest one, then the smaller ones to the smallest. The edges
    never grow in number, and the rounds are few (logarithmic in practice). Each is written to the shared folder, so
    the plan stays short and a lost executor costs one round. Minima are aggregated before they are shuffled, and the
    joins are on node ids, which Spark may split where one is hot; nothing is gathered by node.
    """
    edges = keep(links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = _print(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(down.unionAll(least.select("a", F.col("m").alias("b"))).distinct())
        after = _print(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
