"""Conjugate updates as running aggregates, weights in log space, accuracy measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inverse_gamma_running(rows: DataFrame, error2: Column, shape: float, scale: float) -> DataFrame:
    """Adds the inverse-gamma posterior after each fix of a source: a step adds 1/2 to the shape and half the squared
    error to the scale. ``ig_mean`` is scale / (shape - 1)."""
    w = Window.partitionBy("source_id").orderBy("record_number").rowsBetween(Window.unboundedPreceding, 0)
    n, s = F.lit(shape) + 0.5 * F.count(F.lit(1)).over(w), F.lit(scale) + 0.5 * F.sum(error2).over(w)
    return rows.withColumns({"ig_shape": n, "ig_scale": s}).withColumn("ig_mean", F.col("ig_scale") / (F.col("ig_shape") - 1))


def normalised(rows: DataFrame, log_w: str, keys: list[str]) -> DataFrame:
    """Adds log_total (log of the sum of exponentials, per key) and weight, whose sum per key is 1."""
    w = Window.partitionBy(*keys)
    top = rows.withColumn("_top", F.max(log_w).over(w))
    total = top.withColumn("log_total", F.col("_top") + F.log(F.sum(F.exp(F.col(log_w) - F.col("_top"))).over(w)))
    return total.withColumn("weight", F.exp(F.col(log_w) - F.col("log_total"))).drop("_top")


def mixture_mean(weighted: DataFrame, keys: list[str], edge: str, value: str) -> DataFrame:
    """Per key the edge with the largest total weight (ties, to a millionth: the smallest) and the mean on it."""
    per_edge = weighted.groupBy(*keys, edge).agg(F.sum("weight").alias("edge_weight"), (F.sum(F.col("weight") * F.col(value)) / F.sum("weight")).alias("mean"))
    best = F.max_by(F.struct(edge, "edge_weight", "mean"), F.struct(F.round("edge_weight", 6), -F.col(edge)))
    return per_edge.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def effective_size(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """1 / sum of squared weights, and the number of weights, per key."""
    return weighted.groupBy(*keys).agg((1 / F.sum(F.col("weight") * F.col("weight"))).alias("ess"), F.count(F.lit(1)).alias("n"))


def best_state(weighted: DataFrame, keys: list[str], columns: list[str], log_w: str = "log_w") -> DataFrame:
    """Of each key the row with the largest log weight; ties to the smallest columns."""
    order = F.struct(F.col(log_w), *(-F.col(c) for c in columns))
    return weighted.groupBy(*keys).agg(F.max_by(F.struct(*columns, log_w), order).alias("best")).select(*keys, "best.*")


def counted_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sums weights and counts of equal particles."""
    return rows.groupBy(*keys).agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))


def rmse(rows: DataFrame, error2: Column, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(error2)).alias("rmse"), F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame, found: Column, truth: Column, keys: list[str]) -> DataFrame:
    """Share of rows where two flags agree."""
    return rows.groupBy(*keys).agg(F.avg((found == truth).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, value: str, keys: list[str], accuracy: int | None = None) -> DataFrame:
    """Quartiles and range, mean and sample deviation. Exact quartiles keep all distinct values of a group; with an
    ``accuracy`` they are approximate (to a share of 1 / accuracy of the rows) and merge in bounded memory."""
    shares = [0.25, 0.5, 0.75]
    q = F.percentile_approx(value, shares, accuracy) if accuracy else F.percentile(value, F.array(*map(F.lit, shares)))
    out = rows.groupBy(*keys).agg(F.min(value).alias("least"), q.alias("q"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return out.select(*keys, "least", *(F.get("q", F.lit(k)).alias(n) for k, n in enumerate(("q1", "median", "q3"))), "most", "mean", "sd")
