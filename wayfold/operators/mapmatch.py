"""Between ground and road: snapping, projections of states and covariances.

A ground state is (x, vx, y, vy). A road state is (d, v): distance along the edge and speed along it. With the unit
vector u of a segment, a road state stands for the ground state p + u d, u v.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry as g
from wayfold.operators import network as networks
from wayfold.operators.network import RoadNetwork

SEGMENT = ("x0", "y0", "x1", "y1")


def unit() -> tuple[Column, Column]:
    return (F.col("x1") - F.col("x0")) / F.col("seg_len"), (F.col("y1") - F.col("y0")) / F.col("seg_len")


def snapped(near: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's nearby segments the closest (ties: smallest edge_id, then seg_idx), with the snapped point
    (snap_x, snap_y) and its distance from the start of the edge (along)."""
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "edge_id", "seg_idx"))
    return with_snap(near.withColumn("best", best).where(F.col("best") == 1).drop("best"))


def matched(fixes: DataFrame, network: RoadNetwork, radius: float, keys: list[str], digits: int | None = None) -> DataFrame:
    """`snapped` of the segments within ``radius`` of each fix, with distances to so many ``digits``. Of a network small enough to be sent the closest one is
    found row by row, so that a task never holds and sorts all the segments near its fixes."""
    if network.n_listed(radius) <= networks.BROADCAST_SEGMENTS:
        rows = network.nearest(fixes, radius, digits=digits)
        return with_snap(rows if digits is None else rows.withColumn("dist", F.round("dist", digits)))
    near = network.nearby(fixes, radius)
    return snapped(near if digits is None else near.withColumn("dist", F.round("dist", digits)), keys)


def with_snap(rows: DataFrame) -> DataFrame:
    """Adds the point of each row's segment that is closest to its fix (snap_x, snap_y) and that point's distance from the
    start of the edge (along)."""
    t = g.along(F.col("x"), F.col("y"), *map(F.col, SEGMENT))
    sx, sy = g.at(t, *map(F.col, SEGMENT))
    return rows.withColumns({"snap_x": sx, "snap_y": sy, "along": F.col("start_dist") + t})


def road_observation(rows: DataFrame, a: float, b: float, c: float) -> DataFrame:
    """Adds the fix as seen on its segment: distance along the edge (clamped to the segment) and variance u' R u, for
    the covariance [[a, b], [b, c]]."""
    ux, uy = unit()
    t = g.along(F.col("x"), F.col("y"), *map(F.col, SEGMENT))
    return rows.withColumns({"road_obs": F.col("start_dist") + t, "road_var": a * ux * ux + 2 * b * ux * uy + c * uy * uy})


def ground_from_road(rows: DataFrame, d: Column, v: Column, absolute: bool = False) -> DataFrame:
    """Adds gx, gvx, gy, gvy of a road state; ``absolute`` drops the sign of the speed."""
    ux, uy = unit()
    s = F.abs(v) if absolute else v
    off = d - F.col("start_dist")
    return rows.withColumns({"gx": F.col("x0") + ux * off, "gvx": ux * s, "gy": F.col("y0") + uy * off, "gvy": uy * s})


def road_from_ground(rows: DataFrame, x: Column, vx: Column, y: Column, vy: Column, absolute: bool = False) -> DataFrame:
    """Adds road_d, road_v of a ground state: the closest point of the segment, and the full speed with the sign of its
    direction along the segment (or without)."""
    ux, uy = unit()
    speed = F.sqrt(vx * vx + vy * vy)
    sign = F.lit(1.0) if absolute else F.signum(vx * ux + vy * uy)
    return rows.withColumns({"road_d": F.col("start_dist") + g.along(x, y, *map(F.col, SEGMENT)), "road_v": speed * sign})


def ground_covariance(c00: Column, c01: Column, c11: Column) -> list[Column]:
    """A road covariance as the ten distinct entries of the ground covariance of (x, vx, y, vy)."""
    ux, uy = unit()
    return [ux * ux * c00, ux * ux * c01, ux * uy * c00, ux * uy * c01, ux * ux * c11, ux * uy * c01, ux * uy * c11, uy * uy * c00, uy * uy * c01, uy * uy * c11]


def road_covariance(cxx: Column, cxy: Column, cyy: Column) -> Column:
    """Variance along the segment of a covariance of places."""
    ux, uy = unit()
    return ux * ux * cxx + 2 * ux * uy * cxy + uy * uy * cyy


def ground_belief(c00: Column, c01: Column, c11: Column) -> list[Column]:
    """A road covariance expanded to the ground, by rows of the upper triangle of (x, vx, y, vy): the same for each axis,
    which are independent."""
    zero = F.lit(0.0)
    return [c00, c01, zero, zero, c11, zero, zero, c00, c01, c11]


def road_belief(rows: DataFrame, x: Column, vx: Column, y: Column, vy: Column, cov: tuple[Column, Column, Column], before: tuple[Column, Column, float] | None = None) -> DataFrame:
    """Adds road_d, road_v and the covariance road_c00, road_c01, road_c11 of a ground belief whose axes share ``cov``.
    ``before`` (x, y, time step): the speed is the displacement from there, with the sign of its direction."""
    ux, uy = unit()
    if before is not None:
        px, py, t = before
        vx, vy = (x - px) / t, (y - py) / t
    both = ux * ux + uy * uy
    found = road_from_ground(rows, x, vx, y, vy)
    return found.withColumns({f"road_{n}": both * c for n, c in zip(("c00", "c01", "c11"), cov, strict=True)})
