"""Planar geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))


def along(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from the start of a segment to its point closest to p; 0 on a segment without length."""
    length = distance(x0, y0, x1, y1)
    raw = ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / length
    return F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(length, raw)))


def at(d: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, Column]:
    """The point at a distance from the start of a segment."""
    length = distance(x0, y0, x1, y1)
    share = F.when(length == 0, F.lit(0.0)).otherwise(d / length)
    return x0 + share * (x1 - x0), y0 + share * (y1 - y0)


def point_distance(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance of p from a segment."""
    cx, cy = at(along(px, py, x0, y0, x1, y1), x0, y0, x1, y1)
    return distance(px, py, cx, cy)


def line_length(points: Column) -> Column:
    """Length of an array of struct(x, y)."""
    n = F.size(points)
    pieces = F.transform(
        F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: distance(F.get(points, i)["x"], F.get(points, i)["y"], F.get(points, i + 1)["x"], F.get(points, i + 1)["y"]),
    )
    return F.aggregate(pieces, F.lit(0.0), lambda a, b: a + b)
