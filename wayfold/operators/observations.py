"""Fixes of sources: order, links to the previous fix, extent flags, first velocities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: With a dozen near segments each, and what is summed of them, a task takes some hundred MB.
FIXES_A_TASK = 50_000


def from_events(events: DataFrame) -> DataFrame:
    """The driver's events as fixes: source_id, ts, event_id, x, y (metres within a square kilometre)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").alias("source_id"),
        "ts",
        "event_id",
        (10 * k + F.col("value") % 10).cast("double").alias("x"),
        (10 * (F.col("value") % 100)).cast("double").alias("y"),
        "value",
        k.alias("k"),
    )


def by_source(*more: str):
    return Window.partitionBy("source_id").orderBy("ts", *more)


def linked(fixes: DataFrame, *ties: str) -> DataFrame:
    """Adds record_number (from 0, per source) and the previous fix's place, null at a source's first."""
    w = by_source(*ties)
    return fixes.select("*", (F.row_number().over(w) - 1).alias("record_number"), F.lag("x").over(w).alias("prev_x"), F.lag("y").over(w).alias("prev_y"))


def in_extent(fixes: DataFrame, extent: DataFrame) -> DataFrame:
    """Adds in_extent; rows outside stay, as the flag only warns. ``extent`` has one row."""
    box = extent.first()
    return fixes.withColumn("in_extent", F.col("x").between(box["min_x"], box["max_x"]) & F.col("y").between(box["min_y"], box["max_y"]))


def displacement_velocity(rows: DataFrame, freq: float) -> DataFrame:
    """Adds vx, vy over a constant time step; 0 at a source's first fix."""
    return rows.withColumns({v: F.coalesce((F.col(c) - F.col(f"prev_{c}")) / freq, F.lit(0.0)) for v, c in (("vx", "x"), ("vy", "y"))})


def dealt(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows dealt out by ``keys`` to as many tasks as keep each to about ``FIXES_A_TASK`` of them, before they are multiplied
    and brought together by the keys again. The rows are counted; a shuffle whose number of tasks Spark chooses goes by
    their size before."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // FIXES_A_TASK))
    return rows.repartition(tasks, *keys)
