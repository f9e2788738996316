"""Road networks as DataFrames: edges, segments, adjacency, nearby search, bounded path search.

An edge is directed: edge_id, from_node, to_node, geometry (array of struct(x, y)). A segment is one straight piece of
an edge. The null edge stands for off-road and has no row.

Nearby search is a join on grid cells: each segment is listed under the cells that it passes within the radius; a point
looks in its own cell; the exact distance is tested then. What is listed is sent to all tasks only if it numbers at most
``BROADCAST_SEGMENTS`` rows; a larger network is joined by a shuffle on the cell, which splits a city into as many tasks
as it has cells.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.functions import geometry as g
from wayfold.storage import kept

#: A segment takes about 100 bytes: at most 50 MB are broadcast.
BROADCAST_SEGMENTS = 500_000

EDGE_SCHEMA = "edge_id int, from_node int, to_node int, geometry array<struct<x: double, y: double>>"


def segments_of(edges: DataFrame) -> DataFrame:
    """edge_id, seg_idx, x0, y0, x1, y1, seg_len, start_dist, edge_len, next_seg_idx. Pieces without length are left
    out and not counted."""
    n = F.size("geometry")
    pieces = F.transform(
        F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(F.get("geometry", i)["x"].alias("x0"), F.get("geometry", i)["y"].alias("y0"), F.get("geometry", i + 1)["x"].alias("x1"), F.get("geometry", i + 1)["y"].alias("y1")),
    )
    real = F.filter(pieces, lambda p: (p["x0"] != p["x1"]) | (p["y0"] != p["y1"]))
    rows = edges.select("edge_id", F.posexplode(real).alias("seg_idx", "p")).select("edge_id", "seg_idx", "p.*")
    rows = rows.withColumn("seg_len", g.distance(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    w = Window.partitionBy("edge_id").orderBy("seg_idx")
    before = F.coalesce(F.sum("seg_len").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    whole = F.sum("seg_len").over(Window.partitionBy("edge_id"))
    return rows.select("*", before.alias("start_dist"), whole.alias("edge_len"), F.lead("seg_idx").over(w).alias("next_seg_idx"))


def listed(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """A row for each segment and each cell (cell_x, cell_y: floor of x and y over ``size``) that lies within ``radius`` of
    it. A segment is taken in pieces no longer than a cell, so a long slanted one is not listed all over its box."""
    n = F.greatest(F.lit(1), F.ceil(F.col("seg_len") / size).cast("int"))
    share = lambda i: (i / n).cast("double")
    point = lambda c, i: F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * share(i)
    span = lambda c, i: F.sequence(F.floor((F.least(point(c, i), point(c, i + 1)) - radius) / size), F.floor((F.greatest(point(c, i), point(c, i + 1)) + radius) / size))
    cells = lambda i: F.flatten(F.transform(span("x", i), lambda a: F.transform(span("y", i), lambda b: F.struct(a.alias("cell_x"), b.alias("cell_y")))))
    # the middle of a cell within the radius lies no further off than that and half the cell's diagonal
    t = lambda c: g.point_distance((c["cell_x"] + 0.5) * size, (c["cell_y"] + 0.5) * size, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    every = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), cells)))
    kept = F.filter(every, lambda c: t(c) <= radius + 0.7072 * size)
    return segments.select("*", F.explode(kept).alias("_cell")).select(*segments.columns, "_cell.cell_x", "_cell.cell_y")


@dataclass
class RoadNetwork:
    """A network over an ``edges`` DataFrame."""

    edges: DataFrame
    _spark: SparkSession = field(init=False, repr=False)
    _listed: dict = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self) -> None:
        self._spark = self.edges.sparkSession

    @cached_property
    def segments(self) -> DataFrame:
        return segments_of(self.edges)

    @cached_property
    def n_segments(self) -> int:
        return self.segments.count()

    def sent(self, df: DataFrame) -> DataFrame:
        """Broadcast if the network's size allows it."""
        return F.broadcast(df) if self.n_segments <= BROADCAST_SEGMENTS else df

    def extent(self) -> DataFrame:
        s = self.segments
        box = [f(c).alias(n) for n, f, c in (("min_x", F.min, F.least("x0", "x1")), ("min_y", F.min, F.least("y0", "y1")), ("max_x", F.max, F.greatest("x0", "x1")), ("max_y", F.max, F.greatest("y0", "y1")))]
        return s.agg(*box, F.countDistinct("edge_id").alias("n_edges"), F.sum("seg_len").alias("total_len"))

    def outgoing(self) -> DataFrame:
        """(edge_id, out_edge_id): edges that begin where an edge ends."""
        a, b = self.edges.select("edge_id", "to_node"), self.edges.select(F.col("edge_id").alias("out_edge_id"), "from_node")
        return a.join(self.sent(b), F.col("to_node") == F.col("from_node")).select("edge_id", "out_edge_id")

    def incoming(self) -> DataFrame:
        """(edge_id, in_edge_id): edges that end where an edge begins."""
        a, b = self.edges.select("edge_id", "from_node"), self.edges.select(F.col("edge_id").alias("in_edge_id"), "to_node")
        return a.join(self.sent(b), F.col("from_node") == F.col("to_node")).select("edge_id", "in_edge_id")

    def reverses(self) -> DataFrame:
        """(edge_id, reverse_edge_id, has_reverse): the edge with the reversed geometry, null if there is none."""
        key = lambda points: F.transform(points, lambda p: F.struct(p["x"], p["y"]))
        a = self.edges.select("edge_id", key(F.reverse("geometry")).alias("back"))
        b = self.edges.select(F.col("edge_id").alias("reverse_edge_id"), key(F.col("geometry")).alias("forth"))
        found = a.join(self.sent(b), (F.xxhash64("back") == F.xxhash64("forth")) & (F.col("back") == F.col("forth")), "left")
        return found.groupBy("edge_id").agg(F.min("reverse_edge_id").alias("reverse_edge_id")).withColumn("has_reverse", F.col("reverse_edge_id").isNotNull())

    def same_street(self) -> DataFrame:
        """(edge_id, equal_edge_id): each edge with itself and its reverse."""
        back = self.reverses().where("has_reverse").select("edge_id", F.col("reverse_edge_id").alias("equal_edge_id"))
        return self.edges.select("edge_id", F.col("edge_id").alias("equal_edge_id")).unionAll(back)

    def by_id(self, rows: DataFrame, column: str = "edge_id") -> DataFrame:
        """Rows with the edge that ``column`` names; null where there is none (off-road)."""
        e = self.edges.select(*(F.col(c).alias(f"edge_{c}") for c in self.edges.columns))
        return rows.join(self.sent(e), F.col(column) == F.col("edge_edge_id"), "left")

    def nearby(self, points: DataFrame, radius: float, x: str = "x", y: str = "y", within: Column | None = None) -> DataFrame:
        """``points`` with every segment at a distance under ``radius``, or under a radius of each point's own (``within``,
        at most ``radius``): the segment's columns and ``dist``. Only columns that are asked for are computed."""
        s = listed(self.segments, radius, radius)
        s = s.withColumns({"_ux": (F.col("x1") - F.col("x0")) / F.col("seg_len"), "_uy": (F.col("y1") - F.col("y0")) / F.col("seg_len")})
        p = points.withColumns({"cell_x": F.floor(F.col(x) / radius), "cell_y": F.floor(F.col(y) / radius)})
        joined = p.join(self.sent(s) if self.n_listed(radius) <= BROADCAST_SEGMENTS else s, ["cell_x", "cell_y"])
        dx, dy = F.col(x) - F.col("x0"), F.col(y) - F.col("y0")
        t = F.greatest(F.lit(0.0), F.least(F.col("seg_len"), dx * F.col("_ux") + dy * F.col("_uy")))
        ex, ey = dx - t * F.col("_ux"), dy - t * F.col("_uy")
        d2 = ex * ex + ey * ey
        limit = F.lit(radius) if within is None else within
        return joined.where(d2 < limit * limit).withColumn("dist", F.sqrt(d2)).drop("cell_x", "cell_y", "_ux", "_uy")

    def nearest(self, points: DataFrame, radius: float, x: str = "x", y: str = "y", digits: int | None = None) -> DataFrame:
        """``points`` with the closest of their `nearby` segments (ties, to so many ``digits``: smallest edge_id, then
        seg_idx): one row or none for each, without a row for every segment in between. The network is sent; it must be
        small enough for that."""
        sent = self._spark.sparkContext.broadcast(CellList.of(self.segments, radius))
        kind = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.segments.schema.fields), T.StructField("dist", T.DoubleType())])

        @F.arrow_udf(kind)
        def found(x: pa.Array, y: pa.Array) -> pa.Array:
            return sent.value.nearest(*(c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in (x, y)), digits)

        # once for a row, whatever is asked of it
        return points.withColumn("_near", found.asNondeterministic()(x, y)).where(F.col("_near").isNotNull()).select(*points.columns, "_near.*")

    def n_listed(self, radius: float) -> int:
        """Rows that `nearby` would broadcast: segments times the cells that they pass."""
        if radius not in self._listed:
            self._listed[radius] = listed(self.segments, radius, radius).count()
        return self._listed[radius]

    def segments_between(self, low: float, high: float) -> DataFrame:
        """Segments that begin in a part of their edge: start_dist >= low, up to the first beyond ``high``."""
        return self.segments.where((F.col("start_dist") >= low) & (F.col("start_dist") <= high))

    def edge_facts(self) -> DataFrame:
        """edge_id, length, centre and end points."""
        n = F.size("geometry")
        mean = lambda c: F.aggregate("geometry", F.lit(0.0), lambda a, p: a + p[c]) / n
        last = F.get("geometry", n - 1)
        return self.edges.select("edge_id", g.line_length(F.col("geometry")).alias("length"), mean("x").alias("centre_x"), mean("y").alias("centre_y"), F.get("geometry", F.lit(0))["x"].alias("x_from"), F.get("geometry", F.lit(0))["y"].alias("y_from"), last["x"].alias("x_to"), last["y"].alias("y_to"))

    def paths_to_length(self, length: float) -> DataFrame:
        """(start_edge, path array<int>, path_len): every chain of edges from each edge whose length first reaches
        ``length``. Dead ends before that are dropped. The walk is a recursive query, bounded by the length alone.
        Spark fails beyond its own limits: for chains of over a hundred edges raise ``spark.sql.cteRecursionLevelLimit``,
        for more than a million walks ``spark.sql.cteRecursionRowLimit``."""
        self.edges.select("edge_id", "from_node", "to_node", g.line_length(F.col("geometry")).alias("len")).createOrReplaceTempView("wayfold_edges")
        return self._spark.sql(f"""
            WITH RECURSIVE walk(start_edge, node, path, path_len) AS (
                SELECT edge_id, to_node, array(edge_id), len FROM wayfold_edges
                UNION ALL
                SELECT w.start_edge, e.to_node, concat(w.path, array(e.edge_id)), w.path_len + e.len
                FROM walk w JOIN wayfold_edges e ON e.from_node = w.node WHERE w.path_len < {length})
            SELECT start_edge, path, path_len FROM walk WHERE path_len >= {length}""")

    def edges_at_length(self, length: float) -> DataFrame:
        """(start_edge, edge_id): edges that a walk of ``length`` from each edge can end on."""
        return self.paths_to_length(length).select("start_edge", F.element_at("path", -1).alias("edge_id")).distinct()

    def reach(self, hops: int) -> DataFrame:
        """(node, other, cost): least travel length between nodes within ``hops`` edges."""
        e = self.edges.select("from_node", "to_node", g.line_length(F.col("geometry")).alias("len"))
        e = e.groupBy("from_node", "to_node").agg(F.min("len").alias("len"))
        known = e.select(F.col("from_node").alias("node")).union(e.select("to_node")).distinct().select("node", F.col("node").alias("other"), F.lit(0.0).alias("cost"))
        for _ in range(hops):
            step = known.join(e, known["other"] == e["from_node"]).select("node", F.col("to_node").alias("other"), (F.col("cost") + F.col("len")).alias("cost"))
            known = known.unionAll(step).groupBy("node", "other").agg(F.min("cost").alias("cost"))
        return known

    def within(self, bound: float) -> DataFrame:
        """(node, other, cost): least travel length between nodes no further apart than ``bound``; as many rows as there
        are such pairs. A network small enough to be sent is searched node by node; otherwise rounds of one edge each are
        written to the shared folder until none gets shorter."""
        nodes = self.edges.select(F.col("from_node").alias("node")).union(self.edges.select("to_node")).distinct()
        if self.n_segments <= BROADCAST_SEGMENTS:
            sent = self._spark.sparkContext.broadcast(self.compact())

            def run(batches):
                net = sent.value
                for batch in batches:
                    trees = [(k, net.tree(net.numbers[k], bound)) for k in batch["node"].tolist()]
                    rows = [(k, net.nodes[other], cost) for k, tree in trees for other, (cost, _) in tree.items()]
                    yield pd.DataFrame(rows, columns=["node", "other", "cost"])

            kind = dict(nodes.dtypes)["node"]
            return nodes.mapInPandas(run, f"node {kind}, other {kind}, cost double")
        e = self.edges.select("from_node", "to_node", g.line_length(F.col("geometry")).alias("len"))
        e = kept(e.groupBy("from_node", "to_node").agg(F.min("len").alias("len")))
        known = kept(nodes.select("node", F.col("node").alias("other"), F.lit(0.0).alias("cost"), F.lit(True).alias("new")))
        while True:
            step = known.where("new").join(e, F.col("other") == e["from_node"]).select("node", F.col("to_node").alias("other"), (F.col("cost") + F.col("len")).alias("cost"))
            every = known.select("node", "other", "cost", F.lit(0).alias("round")).unionAll(step.where(F.col("cost") <= bound).withColumn("round", F.lit(1)))
            least = every.groupBy("node", "other").agg(F.min(F.struct("cost", "round")).alias("best"))
            known = kept(least.select("node", "other", "best.cost", (F.col("best.round") == 1).alias("new")))
            if known.where("new").isEmpty():
                return known.drop("new")

    def routes(self, pairs: DataFrame, bound: float) -> DataFrame:
        """``pairs`` (node, other, whatever else) with the edges of the least-length way between the nodes and its
        length; null beyond the bound. Searches share their trees within a task, so nodes are kept together."""
        sent = self._spark.sparkContext.broadcast(self.compact())  # at most BROADCAST_SEGMENTS segments

        def run(batches):
            net = sent.value
            numbers = net.numbers
            for batch in batches:
                at = [(numbers.get(a), numbers.get(b)) for a, b in zip(batch["node"].tolist(), batch["other"].tolist(), strict=True)]
                found = [net.route(a, b, bound) if a is not None and b is not None else None for a, b in at]
                yield batch.assign(way=[None if w is None else [int(net.edge_id[e]) for e in w] for w in found], length=[None if w is None else float(sum(net.edge_len[e] for e in w)) for w in found])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)
        # by node and one of a few numbers, so that a node of many pairs is split
        return pairs.repartition("node", F.pmod(F.xxhash64("other"), F.lit(16))).mapInPandas(run, schema + ", way array<int>, length double")

    def around(self, fixes: DataFrame, reach: float) -> DataFrame:
        """Of each source of ``fixes`` (source_id, x, y) all segments, with their edges' nodes, of the edges that pass
        within ``reach`` of one of its fixes (and some a little further off)."""
        cell = lambda c: F.floor(F.col(c) / reach)
        beside = F.array(*(F.struct((F.col("cx") + i).alias("cell_x"), (F.col("cy") + j).alias("cell_y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
        seen = fixes.select("source_id", cell("x").alias("cx"), cell("y").alias("cy")).distinct().select("source_id", F.explode(beside).alias("c")).select("source_id", "c.*").distinct()
        own = listed(self.segments, 0.0, reach).select("edge_id", "cell_x", "cell_y").distinct()
        wanted = seen.join(own, ["cell_x", "cell_y"]).select("source_id", "edge_id").distinct()
        whole = self.segments.join(self.edges.select("edge_id", "from_node", "to_node"), "edge_id")
        return wanted.join(whole, "edge_id").select(F.col("source_id").alias("source_id"), "edge_id", "seg_idx", "x0", "y0", "x1", "y1", "seg_len", "start_dist", "edge_len", "from_node", "to_node")

    def compact(self) -> CompactNetwork:
        """The network as arrays for what searches paths step by step. Its size is checked: it must fit into every
        executor. The filters do without it beyond that size."""
        if self.n_segments > BROADCAST_SEGMENTS:
            raise ValueError(f"{self.n_segments} segments are too many to send to every executor; split the network by region")
        e = self.edges.select("edge_id", "from_node", "to_node").orderBy("edge_id").collect()
        s = self.segments.orderBy("edge_id", "seg_idx").collect()
        return CompactNetwork.build([tuple(r) for r in e], [(r["edge_id"], r["seg_idx"], r["x0"], r["y0"], r["x1"], r["y1"], r["seg_len"], r["start_dist"], r["edge_len"]) for r in s])


@dataclass
class CellList:
    """Segments in order of (edge_id, seg_idx), and for each cell, by rising key, which of them are `listed` under it."""

    table: pa.Table
    lines: tuple[np.ndarray, ...]
    keys: np.ndarray
    first: np.ndarray
    number: np.ndarray
    #: what is listed under the cells, one cell after the other
    seg: np.ndarray
    radius: float
    box: tuple[int, int, int, int]

    @staticmethod
    def of(segments: DataFrame, radius: float) -> CellList:
        rows = listed(segments, radius, radius).toArrow().combine_chunks()
        rows = rows.sort_by([("edge_id", "ascending"), ("seg_idx", "ascending")])
        cx, cy, edge, part = (rows[c].to_numpy() for c in ("cell_x", "cell_y", "edge_id", "seg_idx"))
        new = np.append(True, (edge[1:] != edge[:-1]) | (part[1:] != part[:-1]))[: len(cx)]
        table = rows.filter(pa.array(new)).drop_columns(["cell_x", "cell_y"]).combine_chunks()
        x0, y0, x1, y1, n = (table[c].to_numpy() for c in ("x0", "y0", "x1", "y1", "seg_len"))
        box = (int(cx.min()), int(cx.max()), int(cy.min()), int(cy.max())) if len(cx) else (0, -1, 0, -1)
        key = (cx - box[0]) * (box[3] - box[2] + 1) + (cy - box[2])
        order = np.argsort(key, kind="stable")
        keys, first, number = np.unique(key[order], return_index=True, return_counts=True)
        return CellList(table, (x0, y0, n, (x1 - x0) / n, (y1 - y0) / n), keys, first, number, (np.cumsum(new) - 1)[order], radius, box)

    def nearest(self, x: np.ndarray, y: np.ndarray, digits: int | None = None) -> pa.StructArray:
        """Of each point the closest segment under the radius with its distance, or null."""
        best, dist = np.full(len(x), -1, dtype=np.int64), np.full(len(x), np.inf)
        with np.errstate(invalid="ignore"):
            cx, cy = np.floor(x / self.radius), np.floor(y / self.radius)
        a, b, c, d = self.box
        inside = np.flatnonzero((cx >= a) & (cx <= b) & (cy >= c) & (cy <= d))
        key = (cx[inside].astype(np.int64) - a) * (d - c + 1) + (cy[inside].astype(np.int64) - c)
        cell = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[cell] == key if len(key) else np.empty(0, dtype=bool)
        who, cell = inside[known], cell[known]
        if len(who):
            n = self.number[cell]
            begin = np.cumsum(n) - n
            seg = self.seg[np.repeat(self.first[cell] - begin, n) + np.arange(int(n.sum()))]
            x0, y0, length, ux, uy = (v[seg] for v in self.lines)
            dx, dy = np.repeat(x[who], n) - x0, np.repeat(y[who], n) - y0
            t = np.maximum(0.0, np.minimum(length, dx * ux + dy * uy))
            ex, ey = dx - t * ux, dy - t * uy
            d2 = ex * ex + ey * ey
            far = np.where(d2 < self.radius * self.radius, np.sqrt(d2), np.inf)
            place = far if digits is None else np.floor(far * 10.0**digits + 0.5)
            same = np.flatnonzero(place == np.repeat(np.minimum.reduceat(place, begin), n))
            owner = np.repeat(np.arange(len(who)), n)[same]
            one = same[np.append(True, owner[1:] != owner[:-1])]
            best[who], dist[who] = seg[one], far[one]
        none = pa.array(np.isinf(dist))
        at = pa.array(np.where(np.isinf(dist), 0, best))
        rows = self.table.take(at) if self.table.num_rows else pa.table({f.name: pa.nulls(len(x), f.type) for f in self.table.schema})
        columns = [*(v.combine_chunks() for v in rows.columns), pa.array(dist)]
        return pa.StructArray.from_arrays(columns, names=[*rows.column_names, "dist"], mask=none)


@dataclass
class CompactNetwork:
    """Segments as arrays, edges by dense index, and least-cost trees from nodes, found when first asked for."""

    edge_id: np.ndarray
    seg_edge: np.ndarray
    p0: np.ndarray
    p1: np.ndarray
    seg_len: np.ndarray
    start: np.ndarray
    edge_len: np.ndarray
    first_seg: np.ndarray
    n_segs: np.ndarray
    from_node: np.ndarray
    to_node: np.ndarray
    out: list[list[int]]
    cells: dict[tuple[int, int], np.ndarray]
    cell: float
    #: the nodes' own ids, in order of their numbers
    nodes: list
    _trees: dict = field(default_factory=dict)
    _fans: dict = field(default_factory=dict)
    _orders: dict = field(default_factory=dict)
    _branches: dict = field(default_factory=dict)
    _loops: dict = field(default_factory=dict)
    _boxes: dict = field(default_factory=dict)
    #: what `filters.Tracker` keeps: log probabilities of turns from a segment to every other, and to its followers
    turns: dict = field(default_factory=dict)
    follower_turns: np.ndarray | None = None

    @staticmethod
    def build(edges: list[tuple], segments: list[tuple], cell: float = 100.0) -> CompactNetwork:
        index = {e[0]: k for k, e in enumerate(edges)}
        nodes = {n: k for k, n in enumerate(sorted({e[1] for e in edges} | {e[2] for e in edges}))}
        s = np.array([(index[r[0]], *r[2:9]) for r in segments], dtype=float).reshape(-1, 8)
        seg_edge = s[:, 0].astype(np.int64)
        leaving: list[list[int]] = [[] for _ in nodes]
        for k, e in enumerate(edges):
            leaving[nodes[e[1]]].append(k)
        edge_len = np.zeros(len(edges))
        edge_len[seg_edge] = s[:, 7]
        cells: dict[tuple[int, int], list[int]] = {}
        for k, (xa, ya, xb, yb) in enumerate(s[:, 1:5]):
            for cx in range(int(np.floor(min(xa, xb) / cell)), int(np.floor(max(xa, xb) / cell)) + 1):
                for cy in range(int(np.floor(min(ya, yb) / cell)), int(np.floor(max(ya, yb) / cell)) + 1):
                    cells.setdefault((cx, cy), []).append(k)
        n_segs = np.bincount(seg_edge, minlength=len(edges))
        return CompactNetwork(
            np.array([e[0] for e in edges], dtype=np.int64),
            seg_edge,
            s[:, 1:3].copy(),
            s[:, 3:5].copy(),
            s[:, 5].copy(),
            s[:, 6].copy(),
            edge_len,
            np.cumsum(n_segs) - n_segs,
            n_segs,
            np.array([nodes[e[1]] for e in edges], dtype=np.int64),
            np.array([nodes[e[2]] for e in edges], dtype=np.int64),
            leaving,
            {k: np.array(v) for k, v in cells.items()},
            cell,
            list(nodes),
        )

    @staticmethod
    def of_rows(rows) -> CompactNetwork:
        """From a pandas frame of segments with their edges' nodes (`RoadNetwork.around`)."""
        rows = rows.sort_values(["edge_id", "seg_idx"], kind="stable")
        first = rows.drop_duplicates("edge_id")
        edges = list(zip(*(first[c].tolist() for c in ("edge_id", "from_node", "to_node")), strict=True))
        columns = ("edge_id", "seg_idx", "x0", "y0", "x1", "y1", "seg_len", "start_dist", "edge_len")
        return CompactNetwork.build(edges, list(zip(*(rows[c].tolist() for c in columns), strict=True)))

    @cached_property
    def numbers(self) -> dict:
        """Numbers of the nodes by their own ids."""
        return {n: k for k, n in enumerate(self.nodes)}

    @cached_property
    def unit(self) -> np.ndarray:
        """Directions of the segments."""
        return (self.p1 - self.p0) / self.seg_len[:, None]

    @cached_property
    def columns(self) -> tuple[np.ndarray, ...]:
        """Of the segments: x and y of the first point and of the direction, and the latter's squares."""
        u = self.unit
        return tuple(np.ascontiguousarray(c) for c in (self.p0[:, 0], self.p0[:, 1], u[:, 0], u[:, 1], u[:, 0] ** 2, u[:, 1] ** 2))

    @cached_property
    def _followers(self) -> tuple[np.ndarray, np.ndarray]:
        last = self.first_seg + self.n_segs - 1
        lists = [[s + 1] if s < last[e] else [int(self.first_seg[f]) for f in self.out[int(self.to_node[e])]] for s, e in enumerate(self.seg_edge.tolist())]
        return np.cumsum([0, *map(len, lists)]), np.array([s for own in lists for s in own], dtype=np.int64)

    @property
    def after_first(self) -> np.ndarray:
        """Where the followers of each segment begin in `after`."""
        return self._followers[0]

    @property
    def after(self) -> np.ndarray:
        """Of each segment the next one of its edge, or the first ones of the edges that leave its end."""
        return self._followers[1]

    def loop(self, e: int, bound: float) -> float:
        """Length of the shortest way round that comes back to an edge; infinite beyond the bound."""
        if (e, bound) not in self._loops:
            back = self.tree(int(self.to_node[e]), bound).get(int(self.from_node[e]))
            self._loops[(e, bound)] = float(self.edge_len[e]) + back[0] if back else float("inf")
        return self._loops[(e, bound)]

    def fan(self, e: int, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The segments of an edge, then those of all edges that begin within ``bound`` of its end, by least ways: the
        segment, its distance from the start of the edge, the place of the segment before it (-1: none; always before
        it), and how many are the edge's own."""
        if (e, bound) not in self._fans:
            own = np.arange(self.first_seg[e], self.first_seg[e] + self.n_segs[e])
            tree = self.tree(int(self.to_node[e]), bound)
            on = np.array([f for node in tree for f in self.out[node]], dtype=np.int64)
            n_out = [len(self.out[node]) for node in tree]
            cost = np.repeat([c for c, _ in tree.values()], n_out)
            by = np.repeat([f for _, f in tree.values()], n_out).astype(np.int64)
            n = self.n_segs[on]
            first = len(own) + np.cumsum(n) - n
            last = np.full(len(self.edge_len) + 1, len(own) - 1)  # the place of each edge's last segment; -1: the edge's own
            last[on] = first + n - 1
            last[-1] = len(own) - 1
            segs = np.repeat(self.first_seg[on] - first, n) + np.arange(len(own), len(own) + int(n.sum()))
            parents = np.arange(len(own) - 1, len(own) - 1 + len(segs))
            parents[(first - len(own))[n > 0]] = last[by][n > 0]
            segs, starts, parents = [own, segs], [self.start[own], self.edge_len[e] + np.repeat(cost, n) + self.start[segs]], [np.arange(-1, len(own) - 1), parents]
            if len(self._fans) >= 2_000:
                self._fans.clear()
            self._fans[(e, bound)] = np.concatenate(segs), np.concatenate(starts), np.concatenate(parents), len(own)
        return self._fans[(e, bound)]

    def ways_to(self, e: int, bound: float, wanted: np.ndarray) -> np.ndarray:
        """Whether each segment of an edge's fan is wanted or leads to one that is: its descendants, counted in an order in
        which they follow it."""
        if (e, bound) not in self._orders:
            parent = self.fan(e, bound)[2].tolist()
            size, begin, free = [1] * len(parent), [0] * len(parent), [0] * (len(parent) + 1)
            for k in range(len(parent) - 1, -1, -1):
                if parent[k] >= 0:
                    size[parent[k]] += size[k]
            for k, p in enumerate(parent):  # the last place of ``free`` is for roots
                begin[k] = free[p]
                free[p] += size[k]
                free[k] = begin[k] + 1
            order = np.empty(len(parent), dtype=np.int64)
            order[begin] = np.arange(len(parent))
            if len(self._orders) >= 2_000:
                self._orders.clear()
            self._orders[(e, bound)] = order, np.array(begin), np.array(begin) + size
        order, begin, end = self._orders[(e, bound)]
        number = np.zeros(len(order) + 1, dtype=np.int64)
        np.cumsum(wanted[order], out=number[1:])
        return number[end] > number[begin]

    def branches(self, seg: int, bound: float) -> tuple[np.ndarray, ...]:
        """Of the fan of a segment's edge: what lies on the way from the segment on, and what is an end of a least way: what
        lies ahead on its own edge at once, what lies behind by a way around."""
        if (seg, bound) not in self._branches:
            e = int(self.seg_edge[seg])
            segs, _, _, n_own = self.fan(e, bound)
            own, ahead = np.arange(len(segs)) < n_own, segs >= seg
            if len(self._branches) >= 2_000:
                self._branches.clear()
            self._branches[(seg, bound)] = ~own | ahead, np.where(own, ahead, ~(ahead & (self.seg_edge[segs] == e)))
        return self._branches[(seg, bound)]

    def project(self, p: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of points (n, 2) and segments: distance along each segment to the closest point, and the distance to it."""
        px, py, dx, dy = (c[seg] for c in self._lines)
        ax, ay, n = p[:, 0] - px, p[:, 1] - py, self.seg_len[seg]
        t = np.clip((ax * dx + ay * dy) / n, 0, n)
        share = t / n
        return t, np.hypot(ax - dx * share, ay - dy * share)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, ...]:
        """x and y of the segments' first points, and what the last ones lie further."""
        d = self.p1 - self.p0
        return tuple(np.ascontiguousarray(c) for c in (self.p0[:, 0], self.p0[:, 1], d[:, 0], d[:, 1]))

    def near(self, p: np.ndarray, radius: float) -> np.ndarray:
        """Segments at a distance under ``radius`` from a point, in order."""
        wide = min(radius, 1e12)
        lo, hi = np.floor((p - wide) / self.cell).astype(int), np.floor((p + wide) / self.cell).astype(int)
        if not np.isfinite(radius) or (hi - lo + 1.0).prod() > len(self.cells):
            found = [np.arange(len(self.seg_len))]
        else:
            found = [self.cells[c] for x in range(lo[0], hi[0] + 1) for y in range(lo[1], hi[1] + 1) if (c := (x, y)) in self.cells]
        if not found:
            return np.empty(0, dtype=np.int64)
        seg = np.unique(np.concatenate(found))
        return seg[self.project(np.broadcast_to(p, (len(seg), 2)), seg)[1] < radius]

    def near_each(self, p: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
        """`near` of many points (n, 2): the point's number and the segment, in order."""
        wide = min(radius, 1e12)
        lo, hi = np.floor((p - wide) / self.cell).astype(int), np.floor((p + wide) / self.cell).astype(int)
        if not len(p) or not np.isfinite(radius) or (hi - lo + 1.0).prod(axis=1).max() > len(self.cells):
            found = [self.near(q, radius) for q in p]
            return np.repeat(np.arange(len(p)), [len(f) for f in found]), np.concatenate([*found, np.empty(0, dtype=np.int64)])
        boxes, of = np.unique(np.concatenate([lo, hi], axis=1), axis=0, return_inverse=True)
        of, lists = of.ravel(), []
        for box in map(tuple, boxes.tolist()):
            if box not in self._boxes:
                if len(self._boxes) > 20_000:
                    self._boxes.clear()
                x0, y0, x1, y1 = box
                cells = [self.cells[c] for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if (c := (x, y)) in self.cells]
                self._boxes[box] = np.unique(np.concatenate(cells)) if cells else np.empty(0, dtype=np.int64)
            lists.append(self._boxes[box])
        size = np.array([len(x) for x in lists])
        first, n = np.cumsum(size) - size, size[of]
        owner = np.repeat(np.arange(len(p)), n)
        seg = np.concatenate(lists)[np.repeat(first[of] - (np.cumsum(n) - n), n) + np.arange(len(owner))]
        kept = self.project(p[owner], seg)[1] < radius
        return owner[kept], seg[kept]

    def near_all(self, p: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """`near` of many points with a radius each: the point's number, the segment and the distance along it, in order.
        Points that look at all segments are worked on together."""
        wide, every = np.minimum(radius, 1e12), np.arange(len(self.seg_len))
        lo, hi = np.floor((p - wide[:, None]) / self.cell), np.floor((p + wide[:, None]) / self.cell)
        whole = ~np.isfinite(radius) | ((hi - lo + 1.0).prod(axis=1) > len(self.cells))
        found = [every if w else self.near(q, x) for q, x, w in zip(p, radius.tolist(), whole.tolist(), strict=True)]
        owner, seg = np.repeat(np.arange(len(p)), [len(f) for f in found]), np.concatenate([*found, _NO_SEGMENT])
        along, far = self.project(p[owner], seg)
        kept = np.flatnonzero(far < radius[owner])
        return owner[kept], seg[kept], along[kept]

    def tree(self, node: int, bound: float) -> dict[int, tuple[float, int]]:
        """Node -> (least length from ``node``, edge that leads there), within ``bound``."""
        key = (node, bound)
        if key not in self._trees:
            done: dict[int, tuple[float, int]] = {}
            queue = [(0.0, node, -1)]
            while queue:
                cost, at, by = heapq.heappop(queue)
                if at in done:
                    continue
                done[at] = (cost, by)
                for e in self.out[at]:
                    if (to := int(self.to_node[e])) not in done and cost + self.edge_len[e] <= bound:
                        heapq.heappush(queue, (cost + self.edge_len[e], to, e))
            if len(self._trees) > 20_000:
                self._trees.clear()
            self._trees[key] = done
        return self._trees[key]

    def route(self, node: int, target: int, bound: float) -> list[int] | None:
        """Edges of the least-length way between two nodes, or None beyond the bound."""
        tree = self.tree(node, bound)
        if target not in tree:
            return None
        way: list[int] = []
        while tree[target][1] >= 0:
            way.append(tree[target][1])
            target = int(self.from_node[way[-1]])
        return way[::-1]


_NO_SEGMENT = np.empty(0, dtype=np.int64)


def search_cost(travelled: Column, length: Column, so_far: Column) -> Column:
    """Cost of a piece of road in a path search for a distance travelled: what it overshoots; nothing before that."""
    return F.abs(F.least(F.lit(0.0), travelled - (length + so_far)))


def search_heuristic(distance: Column, sd: Column, speed: float = 15.0) -> Column:
    """Least time from a place to one about which there is a doubt of ``sd`` metres."""
    return F.greatest(F.lit(0.0), distance - sd) / speed


def grid_edges(spark: SparkSession, nodes: int = 11, spacing: float = 100.0, pieces: int = 2) -> DataFrame:
    """Edges of a square grid in both directions: east, west, north, south in turn, each of ``pieces`` segments."""
    streets = nodes * (nodes - 1)
    e = spark.range(4 * streets).select(F.col("id").cast("int").alias("edge_id"))
    way = F.floor(F.col("edge_id") / streets)
    r = F.col("edge_id") % streets
    level = way < 2
    i = F.when(level, r % (nodes - 1)).otherwise(F.floor(r / (nodes - 1)))
    j = F.when(level, F.floor(r / (nodes - 1))).otherwise(r % (nodes - 1))
    i2, j2 = i + F.when(level, 1).otherwise(0), j + F.when(level, 0).otherwise(1)
    forward = (way == 0) | (way == 2)
    a, b = (F.when(forward, i).otherwise(i2), F.when(forward, j).otherwise(j2)), (F.when(forward, i2).otherwise(i), F.when(forward, j2).otherwise(j))
    point = lambda k: F.struct(*((spacing * (a[c] * (pieces - k) + b[c] * k) / pieces).cast("double").alias(n) for c, n in ((0, "x"), (1, "y"))))
    return e.select("edge_id", (a[0] * nodes + a[1]).cast("int").alias("from_node"), (b[0] * nodes + b[1]).cast("int").alias("to_node"), F.array(*(point(k) for k in range(pieces + 1))).alias("geometry"))
