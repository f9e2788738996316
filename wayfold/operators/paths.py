"""States on paths: clamping, edges at a distance, conversion between paths, differences.

A path is an array of struct(x, y), contiguous and without repeats of a point in a row. On a forward path the distance
runs from 0 at its first point to its length; on a backward path from minus its length at the first point to 0 at the
last. Speeds are along the listed direction on both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import geometry as g
from wayfold.operators import network as networks


def clamp(d: Column, length: Column, backward: Column) -> Column:
    return F.when(backward, F.greatest(-length, F.least(F.lit(0.0), d))).otherwise(F.greatest(F.lit(0.0), F.least(length, d)))


def arc(d: Column, length: Column, backward: Column) -> Column:
    """Distance from the first point along the listed direction."""
    return F.when(backward, length + d).otherwise(d)


def on_path(d: Column, length: Column, backward: Column, tolerance: float = 1.0) -> Column:
    a = arc(d, length, backward)
    return (a >= -tolerance) & (a <= length + tolerance)


def on_edge(d: Column, start: Column, length: Column, tolerance: float = 1e-7) -> Column:
    """Up to the tolerance beyond the end; not before the start."""
    return (d - start >= 0) & (d - start <= length + tolerance)


def checked_on_edge(d: Column, start: Column, length: Column, tolerance: float = 1e-7) -> Column:
    """Distance from the edge's start, pulled onto the edge within the tolerance; null beyond it."""
    own = d - start
    return F.when((own < -tolerance) | (own > length + tolerance), F.lit(None).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(length, own)))


def _point(points: Column, k: int) -> Column:
    """Counted from the end if negative."""
    return F.element_at(points, k + 1 if k >= 0 else k)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lengths_to(points: Column) -> Column:
    """The distance of each point of a path from the first, along the path."""
    n = F.size(points)
    steps = F.transform(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: g.distance(F.get(points, i)["x"], F.get(points, i)["y"], F.get(points, i + 1)["x"], F.get(points, i + 1)["y"]))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def edge_at(points: Column, a: Column) -> Column:
    """Number of the piece of a path that holds the distance ``a`` from its first point; the later one where two meet."""
    return F.size(F.filter(F.slice(lengths_to(points), F.lit(1), F.size(points) - 1), lambda s: s <= a)) - 1


def difference(to_points: Column, to_d: Column, to_v: Column, to_back: Column, from_points: Column, from_d: Column, from_v: Column, from_back: Column) -> tuple[Column, Column]:
    """(distance, speed) of one road state minus another, seen along the first one's path; null if the paths neither
    share an end piece nor meet in an end point."""
    tl, fl = g.line_length(to_points), g.line_length(from_points)
    ta, fa = arc(to_d, tl, to_back), arc(from_d, fl, from_back)
    same = lambda p, q: (p["x"] == q["x"]) & (p["y"] == q["y"])
    piece = lambda a, b: g.distance(a["x"], a["y"], b["x"], b["y"])
    t0, t1, ty, tz = (_point(to_points, k) for k in (0, 1, -2, -1))
    f0, f1, fy, fz = (_point(from_points, k) for k in (0, 1, -2, -1))
    first, last, f_last = piece(t0, t1), piece(ty, tz), piece(fy, fz)
    # (condition, place of the other state along the first path, whether the directions agree)
    cases = [
        (same(t0, f0) & same(t1, f1), fa, True),
        (same(tz, fz) & same(ty, fy), tl - fl + fa, True),
        (same(t0, fy) & same(t1, fz), fa - (fl - f_last), True),
        (same(ty, f0) & same(tz, f1), tl - last + fa, True),
        (same(t0, f1) & same(t1, f0), first - fa, False),
        (same(ty, fz) & same(tz, fy), tl - last + fl - fa, False),
        (same(t0, fz) & same(t1, fy), fl - fa, False),
        (same(ty, f1) & same(tz, f0), tl - fa, False),
        (same(t0, fz), fa - fl, True),
        (same(tz, f0), tl + fa, True),
        (same(t0, f0), -fa, False),
        (same(tz, fz), tl + fl - fa, False),
    ]
    d = v = None
    for condition, place, agrees in cases:
        dd, vv = ta - place, to_v - from_v if agrees else to_v + from_v
        d, v = (F.when(condition, dd), F.when(condition, vv)) if d is None else (d.when(condition, dd), v.when(condition, vv))
    return d, v


def convert(points: Column, d: Column, v: Column, back: Column, onto: Column, onto_back: Column) -> tuple[Column, Column]:
    """A state on one path as (distance, speed) on another."""
    zero = F.lit(0.0)
    length = g.line_length(onto)
    origin = F.when(onto_back, -length).otherwise(zero)
    # the difference to the state at rest at the first point, seen along the other path
    dd, dv = difference(onto, origin, zero, onto_back, points, d, v, back)
    place = -dd
    return F.when(onto_back, place - length).otherwise(place), -dv


def movement(points: Column, a: Column, b: Column) -> Column:
    """Points of a path between two distances from its first point."""
    # batch by batch where the path has two points at least and nothing is null
    return F.coalesce(_movements(points, a.cast("double"), b.cast("double")), _movement(points, a, b))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def _movements(points: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    return moved(points, a, b)


def moved(points: pa.ListArray, a: pa.Array, b: pa.Array) -> pa.ListArray:
    """`movement` of many paths; null for those with less than two points and where anything is null."""
    n = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    p = points.flatten()
    x, y = (p.field(c) for c in ("x", "y"))
    bad = p.is_null().to_numpy(zero_copy_only=False) | x.is_null().to_numpy(zero_copy_only=False) | y.is_null().to_numpy(zero_copy_only=False)
    x, y = (c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y))
    first = np.cumsum(n) - n
    gone = (n < 2) | a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    gone |= np.bincount(np.repeat(np.arange(len(n)), n), weights=bad, minlength=len(n)) > 0
    row = np.flatnonzero(~gone)
    n, first = n[row], first[row]
    ends = [c.to_numpy(zero_copy_only=False)[row] for c in (a, b)]
    # the points of those rows and their distances along the path
    own = np.repeat(np.arange(len(row)), n)
    begin = np.cumsum(n) - n
    place = np.arange(len(own)) - begin[own]
    x, y = x[first[own] + place], y[first[own] + place]
    step = np.zeros(len(own))
    step[1:] = np.sqrt((x[1:] - x[:-1]) * (x[1:] - x[:-1]) + (y[1:] - y[:-1]) * (y[1:] - y[:-1]))
    s = np.zeros(len(own))
    by = np.argsort(place, kind="stable")  # the first points of all, then the second ones
    bounds = np.cumsum(np.bincount(place)) if len(place) else np.zeros(1, dtype=np.int64)
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        k = by[low:high]
        s[k] = s[k - 1] + step[k]
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for d in ends:
            passed = np.bincount(own, weights=~(s > d[own]), minlength=len(row)).astype(np.int64)
            k = begin + np.clip(passed - 1, 0, n - 2)
            x0, y0, x1, y1 = x[k], y[k], x[k + 1], y[k + 1]
            length = np.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))
            share = np.where(length == 0, 0.0, (d - s[k]) / length)
            found.append((x0 + share * (x1 - x0), y0 + share * (y1 - y0)))
    inner = np.flatnonzero((s > ends[0][own]) & ~(s >= ends[1][own]))
    number = np.bincount(own[inner], minlength=len(row)) + 2
    size = np.zeros(len(gone), dtype=np.int64)
    size[row] = number
    at = np.cumsum(number) - number
    out = []
    for c, k in ((x, 0), (y, 1)):
        values = np.empty(int(number.sum()))
        values[at], values[at + number - 1] = found[0][k], found[1][k]
        values[np.arange(len(inner)) + 2 * own[inner] + 1] = c[inner]
        out.append(pa.array(values))
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(out, names=["x", "y"]), mask=pa.array(gone))


def _movement(points: Column, a: Column, b: Column) -> Column:

    def part(p: Column, s: Column) -> Column:
        def at(d: Column) -> Column:
            k = F.greatest(F.lit(0), F.least(F.size(F.filter(s, lambda x: x <= d)), F.size(p) - 1) - 1)
            x, y = g.at(d - F.get(s, k), F.get(p, k)["x"], F.get(p, k)["y"], F.get(p, k + 1)["x"], F.get(p, k + 1)["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        inner = F.filter(F.arrays_zip(s.alias("s"), p.alias("p")), lambda e: (e["s"] > a) & (e["s"] < b))
        return F.concat(F.array(at(a)), F.transform(inner, lambda e: e["p"]), F.array(at(b)))

    return _let(points, lambda p: _let(lengths_to(p), lambda s: part(p, s)))


def merged(a: Column, b: Column) -> Column:
    """One line that holds both, in the direction of ``a``, and whether ``b`` runs the other way: struct(points, reversed),
    null where the lines neither overlap nor meet. A longer overlap wins; the same direction wins over the reversed one,
    and of equal overlaps the one where ``b`` begins earlier."""
    begins = F.when(F.size(b) > 0, F.sequence(1 - F.size(b), F.size(a) - 1))

    def joined(q: Column, turned: bool) -> Column:
        """The longest overlap of ``a`` with q, which begins at place ``at`` of ``a``."""

        def one(at: Column) -> Column:
            low, high = F.greatest(F.lit(0), at), F.least(F.size(a), at + F.size(q))
            same = F.slice(a, low + 1, high - low) == F.slice(q, low - at + 1, high - low)
            return F.struct(F.when(same, high - low).otherwise(F.lit(0)).alias("n"), F.lit(not turned).alias("forth"), (-at).alias("before"))

        return F.array_max(F.transform(begins, one))

    back = F.reverse(b)
    best = F.greatest(joined(b, False), joined(back, True))

    def line(x: Column) -> Column:
        at, q = -x["before"], F.when(x["forth"], b).otherwise(back)
        tail = F.size(a) - at
        ends = F.when(tail < F.size(q), F.slice(q, tail + 1, F.size(q))).otherwise(F.slice(q, 1, 0))
        return F.struct(F.concat(F.slice(q, 1, F.greatest(F.lit(0), -at)), a, ends).alias("points"), (~x["forth"]).alias("reversed"))

    some = F.when(best["n"] > 0, best)
    return F.when(some.isNotNull(), F.get(F.transform(F.array(some), line), F.lit(0)))


def contiguous(lines: Column) -> Column:
    """Whether each of an array of lines begins where the one before ends."""
    end = lambda k: F.element_at(F.get(lines, k), -1)
    begin = lambda k: F.get(F.get(lines, k), F.lit(0))
    n = F.size(lines)
    steps = F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>"))
    return F.forall(steps, lambda k: (end(k)["x"] == begin(k + 1)["x"]) & (end(k)["y"] == begin(k + 1)["y"]))


def built(lines: Column) -> Column:
    """The points of a path of lines, each joint once. Lines that do not join up are an error."""
    rest = F.flatten(F.transform(lines, lambda p, k: F.when(k == 0, p).otherwise(F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1)))))
    return F.when(contiguous(lines), rest).otherwise(F.raise_error(F.lit("the lines of a path do not join up")))


def geometry_of(walks: DataFrame, network, path: str = "path") -> DataFrame:
    """``walks`` with ``lines``, the lines of the edges of ``path`` (ids) in order; edges that are not there are left out.
    Of a network small enough to be sent they are looked up row by row; otherwise walks are brought together again by a
    shuffle, and told apart by all their columns."""
    if network.n_segments <= networks.BROADCAST_SEGMENTS:
        return looked_up(walks, network, path).where(F.size("lines") > 0)
    key = "_walk"
    numbered = walks.withColumn(key, F.struct(*walks.columns))
    legs = numbered.select(key, F.posexplode(path).alias("at", "edge_id")).join(network.sent(network.edges.select("edge_id", "geometry")), "edge_id")
    lines = legs.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "geometry"))), lambda x: x["geometry"]).alias("lines"))
    return lines.select(f"{key}.*", "lines")


def looked_up(walks: DataFrame, network, path: str = "path") -> DataFrame:
    """Every row with the ``lines`` of its path, none where it has no path; the network is sent."""
    streets = network.edges.where("geometry is not null").select("edge_id", "geometry").orderBy("edge_id").toArrow().combine_chunks()
    ids = streets["edge_id"].to_numpy().astype(float)  # an id is an int
    sent = walks.sparkSession.sparkContext.broadcast((ids, streets["geometry"].combine_chunks()))

    def run(batches):
        ids, lines = sent.value
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(path))
            n = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
            row, e = np.repeat(np.arange(len(n)), n), pc.fill_null(own.flatten().cast(pa.float64()), math.nan).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(ids, e), max(len(ids) - 1, 0))
            there = np.flatnonzero(ids[at] == e) if len(ids) else np.empty(0, dtype=np.int64)
            found = lines.take(pa.array(at[there]))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[there], minlength=len(n)))])
            whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found)
            yield pa.RecordBatch.from_arrays([*batch.columns, whole], names=[*batch.schema.names, "lines"])

    line = network.edges.schema["geometry"].dataType
    return walks.mapInArrow(run, T.StructType([*walks.schema.fields, T.StructField("lines", T.ArrayType(line))]))


def path_to(points: Column, d: Column) -> Column:
    """The part of a path up to a distance from its first point."""
    return movement(points, F.lit(0.0), d)


def path_from(points: Column, k: Column) -> Column:
    """The part of a path from its k-th piece on."""
    return F.slice(points, k + 1, F.size(points))


def clamp_to_edge(d: Column, start: Column, length: Column, nudge: float = 1e-4) -> Column:
    """A distance pulled onto an edge, a little inside it; one that lies on it stays."""
    return F.when(d - start < 0, start + nudge).when(d - start > length, start + length - nudge).otherwise(d)


def plus(a: tuple[Column, Column], b: tuple[Column, Column], scale: float = 1.0) -> tuple[Column, Column]:
    """A path state (distance, speed) plus a multiple of another's; states on different paths are converted before."""
    return a[0] + scale * b[0], a[1] + scale * b[1]


def dot(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1]


def norm(a: tuple[Column, Column]) -> Column:
    return F.sqrt(dot(a, a))


def ordered(points: Column, d: Column, v: Column) -> Column:
    """What states on paths are ordered by: the path's points, then distance and speed."""
    return F.struct(F.transform(points, lambda p: F.struct(p["x"], p["y"])).alias("points"), d.alias("d"), v.alias("v"))


def against(v: Column, to_x: Column, to_y: Column, from_x: Column, from_y: Column) -> Column:
    """A speed along one direction as seen along another: the sign turns if they are opposed."""
    return F.when(to_x * from_x + to_y * from_y < 0, -v).otherwise(v)


def without_prefixes(rows: DataFrame, path: str = "path") -> DataFrame:
    """Drops every path that another one continues. A path is looked up among the proper prefixes of all, so the join
    is on equal arrays."""
    shorter = rows.where(F.size(path) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda n: F.slice(F.col(path), F.lit(1), n))).alias("_prefix")).distinct()
    return rows.join(shorter, F.col(path) == F.col("_prefix"), "left_anti")
