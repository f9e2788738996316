"""Fixed cases of the model: projection, states on paths, filters on small networks, bounds against simulated truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import gaussian, geo
from wayfold.operators import learning, mapmatch, motion, observations, paths
from wayfold.operators import network as networks
from wayfold.operators.filters import METHODS, NAMES, OFF, Cloud, Tracker, filter_fixes, filter_trace, initial_values
from wayfold.operators.network import EDGE_SCHEMA, CompactNetwork, RoadNetwork, grid_edges, listed, segments_of
from wayfold.operators.simulation import simulate_trace
from wayfold.params import TrackingParameters

CERTAIN = 2.0**31 - 1


def network(*lines):
    nodes, edges, segments = {}, [], []
    for k, line in enumerate(lines):
        edges.append((k, nodes.setdefault(line[0], len(nodes)), nodes.setdefault(line[-1], len(nodes))))
        lengths = [math.dist(p, q) for p, q in zip(line, line[1:], strict=False)]
        for i, (p, q) in enumerate(zip(line, line[1:], strict=False)):
            segments.append((k, i, *map(float, p), *map(float, q), lengths[i], sum(lengths[:i]), sum(lengths)))
    return CompactNetwork.build(edges, segments)


FORK = network(((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 0), (1, -1)), ((1, 1), (1, 2)), ((1, 2), (1, 3)))
SQUARE = network(((0, 0), (100, 0)), ((100, 0), (100, 100)), ((100, 100), (0, 100)), ((0, 100), (0, 0)))
FORK_PARAMS = TrackingParameters(
    obs_cov=(0.02, 0.02), obs_cov_dof=CERTAIN, on_road_cov=(1e-4,), on_road_cov_dof=CERTAIN, off_road_cov=(1e-4, 1e-4), off_road_cov_dof=CERTAIN,
    off_probs=(1, CERTAIN), on_probs=(CERTAIN, 1), particles=1, freq=4, initial_motion=(0, 1, 0, 0),
)


@pytest.mark.parametrize(("lat", "lon"), [(42.017, -87.675), (40.756, -73.981), (-28.78, -65.63), (31.7, 35.0), (11.4, 122.8)])
def test_projection_round_trip(spark, lat, lon):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    df = df.select("*", x.alias("x"), y.alias("y"), geo.epsg(F.col("lat"), F.col("lon")).alias("code"))
    back = geo.from_utm(F.col("x"), F.col("y"), F.col("code"))
    row = df.select("x", *(c.alias(n) for c, n in zip(back, ("a", "b"), strict=True))).first()
    assert row["a"] == pytest.approx(lat, abs=1e-7) and row["b"] == pytest.approx(lon, abs=1e-7)


def test_known_utm_point_and_zones(spark):
    # the CN Tower, as in public UTM references: zone 17, 630084 E, 4833438 N
    df = spark.createDataFrame([(43.642567, -79.387139)], "lat double, lon double")
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    row = df.select(x.alias("x"), y.alias("y"), geo.utm_zone(F.col("lon")).alias("z")).first()
    assert row["z"] == 17 and row["x"] == pytest.approx(630084, abs=1.5) and row["y"] == pytest.approx(4833438, abs=1.5)
    edge = spark.createDataFrame([(0.0, 180.0), (-1.0, -180.0)], "lat double, lon double").select(geo.epsg(F.col("lat"), F.col("lon")).alias("e"))
    assert [r["e"] for r in edge.collect()] == [32660, 32701]
    with pytest.raises(Exception, match="out of range"):
        spark.createDataFrame([(181.0,)], "lon double").select(geo.utm_zone(F.col("lon"))).collect()


POINTS = "array<struct<x: double, y: double>>"


def states(spark, *rows):
    schema = f"p {POINTS}, d double, v double, b boolean, q {POINTS}, e double, w double, c boolean"
    return spark.createDataFrame([tuple([(float(x), float(y)) for x, y in r[k]] if k in (0, 4) else r[k] if k in (3, 7) else float(r[k]) for k in range(8)) for r in rows], schema)


UP, UPPER, DOWN = [(0, 10), (0, 20), (0, 30)], [(0, 20), (0, 30), (0, 40)], [(0, 30), (0, 20), (0, 10)]
BACK, LOOP = [(0, 40), (0, 30), (0, 20)], [(0, 0), (0, 179), (10, 179), (56, 179)]


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ((UP, 7, 2, False, UP, 5, 1, False), (2, 1)),
        ((UPPER, 17.5, -1, False, UP, 12.5, 1, False), (15, -2)),
        ((BACK, -17.5, -1, True, UP, 12.5, 1, False), (-15, 0)),
        ((LOOP[:2], 157, 7.5, False, LOOP, -41, 4, True), (-37, 3.5)),
        ((UP, 5, 1, False, UP, -13, -2, True), (-2, 3)),
        ((UPPER, 17.5, 1, False, DOWN, 12.5, 1, False), (20, 2)),
        ((BACK, -17.5, 1, True, DOWN, 12.5, 1, False), (-20, 0)),
        (([(0, 0), (5, 0)], 1, 1, False, [(-5, 0), (0, 0)], 4, 1, False), (2, 0)),
        (([(0, 0), (5, 0)], 1, 1, False, [(50, 50), (60, 60)], 4, 1, False), (None, None)),
    ],
)
def test_state_difference(spark, row, expected):
    d, v = paths.difference(*map(F.col, "pdvb"), *map(F.col, "qewc"))
    got = states(spark, row).select(d.alias("x"), v.alias("y")).first()
    assert tuple(got) == (pytest.approx(expected) if expected[0] is not None else expected)


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        (([(0, 0), (0, 60)], 12, -1, False, [(0, 60), (0, 0)], 0, 0, True), (-12, 1)),
        (([(10, 0), (0, 0)], -2.5, 1, True, [(20, -10), (10, -10), (10, 0), (0, 0)], 0, 0, True), (-2.5, 1)),
        (([(0, 0), (10, 0), (10, -10), (20, -10)], 2.5, 1, False, [(10, 0), (0, 0)], 0, 0, False), (7.5, -1)),
        (([(0, 0), (10, 0)], 0, -5 / 30, True, [(20, -10), (10, -10), (10, 0), (0, 0)], 0, 0, True), (-10, 5 / 30)),
        (([(0, 0), (10, 0)], 2.5, 1, False, [(0, 0), (10, 0), (10, -10), (20, -10)], 0, 0, False), (2.5, 1)),
        (([(0, 0), (10, 0), (10, -10), (20, -10)], 2.5, 1, False, [(0, 0), (10, 0)], 0, 0, True), (-7.5, 1)),
        (([(20, -10), (10, -10), (10, 0), (0, 0)], -2.5, 1, True, [(10, 0), (0, 0)], 0, 0, False), (7.5, 1)),
    ],
)
def test_state_conversion(spark, row, expected):
    d, v = paths.convert(*map(F.col, "pdvb"), F.col("q"), F.col("c"))
    assert tuple(states(spark, row).select(d, v).first()) == pytest.approx(expected)


def test_edges_of_paths(spark):
    df = spark.range(1).select(F.array(*(F.struct(F.lit(x).alias("x"), F.lit(0.0).alias("y")) for x in (0.0, 10.0, 30.0))).alias("p"))
    got = df.select(*(paths.edge_at(F.col("p"), F.lit(d)) for d in (0.0, 9.9, 10.0, 29.0)), paths.movement(F.col("p"), F.lit(5.0), F.lit(12.0)).alias("m")).first()
    assert list(got)[:4] == [0, 0, 1, 1] and [(p["x"], p["y"]) for p in got["m"]] == [(5, 0), (10, 0), (12, 0)]
    checks = df.select(*(paths.checked_on_edge(F.lit(d), F.lit(0.0), F.lit(5.0)) for d in (-1e-12, 1e-12, -1e-6, 5.0000001, 6.0))).first()
    assert list(checks) == [0.0, 1e-12, None, 5.0, None]


def test_road_and_ground_states_agree(spark):
    row = [(-100.0, 0.0, 100.0, 0.0, 200.0, 0.0, 40.0, -13.54)]
    df = spark.createDataFrame(row, "x0 double, y0 double, x1 double, y1 double, seg_len double, start_dist double, d double, v double")
    ground = mapmatch.ground_from_road(df, F.col("d"), F.col("v"))
    back = mapmatch.road_from_ground(ground, *map(F.col, ("gx", "gvx", "gy", "gvy"))).first()
    assert (back["gx"], back["road_d"], back["road_v"]) == pytest.approx((-60, 40, -13.54))


def test_network_from_lines(spark):
    edges = spark.createDataFrame([(1, 0, 1, [(0.0, 0.0), (0.0, 0.0), (3.0, 4.0), (3.0, 8.0)])], "edge_id int, from_node int, to_node int, geometry " + POINTS)
    got = segments_of(edges).orderBy("seg_idx").collect()
    assert [(r["seg_len"], r["start_dist"], r["edge_len"], r["next_seg_idx"]) for r in got] == [(5, 0, 9, 1), (4, 5, 9, None)]


def test_nearby_equals_brute_force(spark):
    net = RoadNetwork(grid_edges(spark, 4, 50.0))
    rng = np.random.default_rng(1)
    p = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-40, 190, (60, 2)))]
    points = spark.createDataFrame(p, "id int, x double, y double")
    got = {(r["id"], r["edge_id"], r["seg_idx"]) for r in net.nearby(points, 33.0).collect()}
    compact, segs = net.compact(), net.segments.orderBy("edge_id", "seg_idx").collect()
    want = {(k, segs[s]["edge_id"], segs[s]["seg_idx"]) for k, x, y in p for s in range(len(segs)) if compact.project(np.array([[x, y]]), np.array([s]))[1][0] < 33.0}
    assert got == want
    assert all({(k, segs[s]["edge_id"], segs[s]["seg_idx"]) for s in compact.near(np.array([x, y]), 33.0)} == {w for w in want if w[0] == k} for k, x, y in p)


def test_paths_of_many_short_edges(spark):
    line = "array(named_struct('x', 5.0D * id, 'y', 0.0D), named_struct('x', 5.0D * id + 5, 'y', 0.0D)) AS geometry"
    edges = spark.range(70).selectExpr("int(id) AS edge_id", "int(id) AS from_node", "int(id + 1) AS to_node", line)
    got = RoadNetwork(edges).paths_to_length(300.0).collect()
    assert sorted((r["start_edge"], len(r["path"]), r["path_len"]) for r in got) == [(k, 60, 300.0) for k in range(11)]


def test_routes(spark):
    net = RoadNetwork(grid_edges(spark, 4, 50.0)).compact()
    way = net.route(0, 15, 1000.0)
    assert len(way) == 6 and net.from_node[way[0]] == 0 and net.to_node[way[-1]] == 15
    assert all(net.to_node[a] == net.from_node[b] for a, b in zip(way, way[1:], strict=False))
    assert net.route(0, 15, 200.0) is None and net.route(3, 3, 10.0) == []


@pytest.mark.parametrize("method", ["pl", "path_sampling"])
def test_filter_reaches_the_last_edge(method):
    t = Tracker(FORK, FORK_PARAMS, method)
    t.start(np.array([0.0, 0.0]), None)
    t.step(np.array([1.0, 3.0]), 1)
    best = dict(zip(NAMES, t.best(1), strict=True))
    assert best["on_road"] and best["edge_id"] == 4 and (best["x"], best["y"]) == pytest.approx((1, 3), abs=0.1) and best["path"] == [0, 1, 3, 4]


def crooked(seed=3, n=6):
    """A grid with moved nodes and one-way streets, so that no two ways are equally long."""
    rng = np.random.default_rng(seed)
    at = {(i, j): (100 * i + rng.uniform(-30, 30), 100 * j + rng.uniform(-30, 30)) for i in range(n) for j in range(n)}
    lines = []
    for (i, j), p in at.items():
        for q in ((i + 1, j), (i, j + 1)):
            if q in at:
                lines += [(p, at[q])] + ([(at[q], p)] if rng.random() < 0.8 else [])
    return network(*lines)


def plain_walk(net, p_seg, mean, cov, r, xy, bound):
    """The guided walk by one particle, best first, with plain floats."""
    import heapq

    half = 1.959964 * math.sqrt(cov[0])
    cap = mean[2] + bound
    low, high, radius = min(max(0, mean[0] - half), cap), min(mean[0] + half, cap), 2.5 * math.sqrt(r * math.sqrt(2))

    def likely(s, start):
        n, u = net.seg_len[s], net.unit[s]
        w = cov[0] / (cov[0] + n * n / 12)
        own = min(max(mean[0] + w * (start + n / 2 - mean[0]) - start, 0), n)
        c = cov[0] - w * w * (cov[0] + n * n / 12)
        e = xy - net.p0[s] - u * own
        m = r * np.eye(2) + c * np.outer(u, u)
        return -math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(m)) - 0.5 * e @ np.linalg.solve(m, e), math.hypot(*e)

    def turn(a, b):
        cos = -float(net.unit[a] @ net.unit[b])
        sharp = cos > 0 and min(net.edge_len[net.seg_edge[a]], net.edge_len[net.seg_edge[b]]) * math.sqrt(max(0, 1 - cos * cos)) < 15 and net.seg_edge[a] != net.seg_edge[b]
        return math.log(0.1 if sharp else 0.9)

    start = float(net.start[p_seg])
    total = likely(p_seg, start)[0]
    queue, out, done = [(-total, p_seg, start, 1, 0.0, -math.inf)], {}, set()
    while queue:
        total, s, start, steps, trans, before = heapq.heappop(queue)
        total = -total
        if (s, round(start, 3)) in done:
            continue
        done.add((s, round(start, 3)))
        end = start + net.seg_len[s]
        if (start <= high and end >= low) or likely(s, start)[1] <= radius:
            out[(s, round(start, 3))] = trans
        if end > cap:
            continue
        for f in net.after[net.after_first[s] : net.after_first[s + 1]].tolist():
            t = turn(s, f)
            if steps + 1 > 2:
                t = np.logaddexp(trans, t) - math.log(steps)
            new = likely(f, end)[0] + t
            if new >= total or before == -math.inf or new >= before:
                heapq.heappush(queue, (-new, f, end, steps + 1, t, total))
    return out


@pytest.mark.parametrize("goal", [(330.0, 210.0), (60.0, 340.0), (480.0, 470.0)])
def test_guided_walk_equals_a_plain_one(goal):
    net, xy = crooked(), np.array(goal)
    t = Tracker(net, TrackingParameters(particles=4, obs_cov=(150.0, 150.0)), "path_sampling")
    t.start(np.array([110.0, 100.0]), None)
    on = np.flatnonzero(t.cloud.seg != OFF)
    mean, cov = np.tile([420.0, 14.0], (len(t.cloud), 1)), np.tile([60.0**2, 10.0, 1.0], (len(t.cloud), 1))
    forest, turns = t._walked(t.cloud, on, xy, mean, cov)
    for k in on.tolist():
        own = np.flatnonzero((forest.owner == k) & forest.target)
        got = {(int(forest.seg[i]), round(float(forest.start[i]), 3)): turns[i] for i in own}
        want = plain_walk(net, int(t.cloud.seg[k]), (420.0, 14.0, float(t.cloud.mean[k, 0])), (60.0**2,), 150.0, xy, 1620.0)
        assert want and set(got) == set(want)
        assert all(got[s] == pytest.approx(want[s]) for s in want)


def test_options_of_particle_learning_equal_plain_paths():
    """Weights of all ends of paths, from the formulas, path by path."""
    net, xy = crooked(), np.array([305.0, 190.0])
    prm = TrackingParameters(particles=6, obs_cov=(150.0, 150.0))
    t = Tracker(net, prm, "pl")
    t.start(np.array([110.0, 100.0]), None)
    t.cloud.mean[t.cloud.seg != OFF, 1] = 7.0
    o = t.options(xy)
    c = t.cloud
    for k in np.flatnonzero(c.seg != OFF).tolist():
        s0, m = int(c.seg[k]), np.array([[1, 30], [0, 1.0]]) @ c.mean[k, :2]
        full = np.array([[c.cov[k, 0], c.cov[k, 1]], [c.cov[k, 1], c.cov[k, 2]]])
        a, g = np.array([[1, 30], [0, 1.0]]), np.array([450.0, 30.0])
        cov = a @ full @ a.T + c.road[k, 2] * np.outer(g, g)
        r, e0 = c.obs[k, 2], int(net.seg_edge[s0])
        every = np.arange(len(net.seg_len))
        near = every[net.project(np.broadcast_to(xy, (len(every), 2)), every)[1] < prm.radius(r)]
        found = []
        for s in near.tolist():
            e = int(net.seg_edge[s])
            way = [e0] if e == e0 and s >= s0 else None
            if way is None:
                route = net.route(int(net.to_node[e0]), int(net.from_node[e]), prm.path_search_bound)
                if route is None:
                    continue
                way = [e0, *route, e]
            parts, before = [], 0.0
            for j, f in enumerate(way):
                for i in range(net.n_segs[f]):
                    q = int(net.first_seg[f]) + i
                    if (j == 0 and q < s0) or (j == len(way) - 1 and q > s):
                        continue
                    start, n, u = before + net.start[q], net.seg_len[q], net.unit[q]
                    spread = cov[0, 0] + n * n / 12
                    w = cov[:, 0] / spread
                    d = m[0] + w[0] * (start + n / 2 - m[0])
                    if not start - 1 <= d <= start + n + 1:
                        continue
                    density = -0.5 * (math.log(2 * math.pi * cov[0, 0]) + (d - m[0]) ** 2 / cov[0, 0])
                    left = cov[0, 0] - w[0] ** 2 * spread
                    e1 = xy - net.p0[q] - u * min(max(d - start, 0), n)
                    s2 = r * np.eye(2) + left * np.outer(u, u)
                    like = -math.log(2 * math.pi) - 0.5 * math.log(np.linalg.det(s2)) - 0.5 * e1 @ np.linalg.solve(s2, e1)
                    parts.append((density, like + float(t._turn(np.array([s0]), np.array([q]))[0])))
                before += net.edge_len[f]
            if parts:
                top = np.logaddexp.reduce([x for x, _ in parts])
                found.append(np.logaddexp.reduce([x - top + y for x, y in parts]))
        want = sorted(np.array(found) - math.log(len(found)) - math.log(2) + math.log(c.on[k, 2])) if found else []
        own = (o.owner == k) & (o.kind == 1)
        whole = own & np.isin(o.at, np.flatnonzero(o.forest.parent >= -1)[: len(o.forest.seg)])
        assert sorted(o.log_w[whole]) == pytest.approx(want)


def test_propagation_follows_the_road_and_leaves_at_a_dead_end():
    from dataclasses import replace

    calm = replace(FORK_PARAMS, on_road_cov=(0.0,), off_road_cov=(0.0, 0.0), on_probs=(math.inf, 1.0))

    def moved(net, params, mean, seg=0, seed=0):
        believed = initial_values(params)
        one = Cloud(np.array([seg]), np.array([[*mean, 0.0, 0.0][:4]]), np.zeros((1, 3)), *(believed[k][None, :] for k in ("obs", "road", "ground", "on", "off")), [()])
        out = Tracker(net, params, "bootstrap").propagate(one, np.random.default_rng(seed))
        return int(out.seg[0]), out.mean[0]

    assert {moved(FORK, calm, (0.4, 1 / 40), seed=k)[0] for k in range(5)} == {0}
    far = [moved(FORK, calm, (0.0, 1.0), seed=k)[0] for k in range(20)]
    assert 4 in far and set(far) <= {4, OFF}
    short = network(((0, 0), (1, 0)), ((1, 0), (1, 1)), ((1, 0), (1, -1)), ((1, 1), (1, 2)))
    seg, mean = moved(short, calm, (0.0, 1.0))
    assert seg == OFF and mean == pytest.approx((4, 1, 0, 0))
    # certain to leave the road
    leaving = replace(calm, on_probs=(1.0, CERTAIN), off_probs=(CERTAIN, 1.0))
    seg, mean = moved(FORK, leaving, (0.0, 1.0))
    assert seg == OFF and mean == pytest.approx((4, 1, 0, 0))
    # from the ground onto the road, with the whole speed
    onto = replace(calm, freq=1.0, obs_cov=(0.1, 0.1), off_probs=(1.0, math.inf))
    ends = [moved(FORK, onto, (0.0, 1.0, 0.0, 2.0), seg=OFF, seed=k) for k in range(12)]
    assert all(s in (3, 4) for s, _ in ends) and all(m[1] == pytest.approx(math.sqrt(5)) for _, m in ends)
    # noise on the road never shortens a step
    noisy = replace(calm, on_road_cov=(1e-2,))
    assert min(moved(SQUARE, noisy, (10.0, 5.0), seed=k)[1][1] for k in range(30)) >= 5.0


@pytest.mark.parametrize("method", METHODS)
def test_filter_follows_a_simulated_vehicle(method):
    """25 particles on a square loop; the bounds are those set for the model: 5 standard deviations in each component."""
    params = TrackingParameters(obs_cov=(70, 70), off_probs=(1, CERTAIN), on_probs=(CERTAIN, 1), seed=5)
    trace = simulate_trace(SQUARE, params, 1, 60)
    seen, truth = np.array([r[3:5] for r in trace]), np.array([[r[9], r[11]] for r in trace])
    assert np.abs((seen - truth).mean(axis=0)).max() <= 2 * math.sqrt(70 * math.sqrt(2))
    got = [dict(zip(NAMES, r, strict=True)) for r in filter_trace(SQUARE, params, method, 1, seen, list(range(len(seen))))]
    assert len(got) == len(seen) and all(r["explained"] for r in got)
    error = np.array([[r["x"], r["y"]] for r in got]) - truth
    assert np.abs(error.mean(axis=0)).max() <= 5 * math.sqrt(70)
    assert np.sqrt((error**2).sum(axis=1).mean()) <= 2.5 * math.sqrt(70)
    assert np.linalg.norm(np.cov((seen - truth).T) - 70 * np.eye(2)) <= 0.7 * 70 * math.sqrt(2)
    for r in got:  # paths join up and end on the state's edge
        p = r["path"]
        assert (p is None) != r["on_road"] and (p is None or (p[-1] == r["edge_id"] and all(SQUARE.to_node[e] == SQUARE.from_node[f] for e, f in zip(p, p[1:], strict=False))))
    assert np.mean([r["on_road"] for r in got]) > 0.95


def test_variances_are_learnt_over_edge_changes():
    """At 30 s steps nearly every step changes edge; acceleration and measurement variances are learnt all the same."""
    params = TrackingParameters(obs_cov=(70, 70), on_road_cov=(5e-3,), on_road_cov_dof=3.0, off_probs=(1, CERTAIN), on_probs=(CERTAIN, 1), seed=2)
    calm = TrackingParameters(obs_cov=(70, 70), on_road_cov=(1e-6,), off_probs=(1, CERTAIN), on_probs=(CERTAIN, 1), seed=2)
    trace = simulate_trace(SQUARE, calm, 1, 80)
    got = filter_trace(SQUARE, params, "pl", 1, np.array([r[3:5] for r in trace]), list(range(80)))
    at = NAMES.index("on_road_var")
    assert np.median([r[at] for r in got[-20:]]) < 2.5e-3


def test_hooks_replace_beliefs_and_learning():
    from wayfold.operators.filters import learn_variance

    asked = []
    hooks = {"initial": lambda p: initial_values(p) | {"obs": np.array([20.0, 19.0, 1.0])}, "variance": lambda ig, e2, rng: asked.append(len(ig)) or learn_variance(ig, e2, rng), "switching": lambda c, stayed, rng: c}
    got = filter_trace(SQUARE, TrackingParameters(obs_cov=(70, 70)), "pl", "veh0", np.array([[10.0, 1.0], [60.0, 0.0]]), [0, 1], hooks=hooks)
    first = dict(zip(NAMES, got[0], strict=True))
    assert first["obs_var"] == 1.0 and asked and {r[NAMES.index("p_on_on")] for r in got} == {0.95}


def test_region_by_region_equals_the_whole_network(spark, monkeypatch):
    net = RoadNetwork(grid_edges(spark))
    rng = np.random.default_rng(0)
    rows = [(f"veh{k}", i, float(60 * i + rng.normal(0, 5)), float(100 * k + rng.normal(0, 5)), f"note {i}") for k in range(3) for i in range(6)]
    fixes = spark.createDataFrame(rows, "source_id string, record_number int, x double, y double, note string")
    whole = sorted(map(repr, filter_fixes(fixes, net, TrackingParameters(particles=6)).collect()))
    assert "note 5" in whole[-1] and "veh2" in whole[-1]
    monkeypatch.setattr(networks, "BROADCAST_SEGMENTS", 100)
    large = RoadNetwork(grid_edges(spark))
    assert sorted(map(repr, filter_fixes(fixes, large, TrackingParameters(particles=6), reach=5_000.0).collect())) == whole
    with pytest.raises(ValueError, match="too many"):
        large.compact()


def test_long_slanted_segments_are_listed_where_they_pass(spark):
    one = spark.createDataFrame([(1, 0, 0.0, 0.0, 20_000.0, 20_000.0, math.hypot(2e4, 2e4), 0.0, math.hypot(2e4, 2e4), None)], "edge_id int, seg_idx int, x0 double, y0 double, x1 double, y1 double, seg_len double, start_dist double, edge_len double, next_seg_idx int")
    assert listed(one, 60.0, 60.0).count() < 3_000


def test_axis_filter_and_smoothing_limits():
    z = np.cumsum(np.full(200, 3.0))
    out = motion.axis_filter(z, 1.0, 4.0, 0.01)
    assert out[-1, :2] == pytest.approx((600, 3), abs=0.1)
    assert np.all(out[:, 2] * out[:, 4] >= out[:, 3] ** 2 - 1e-9)


def test_ground_filter_over_batches(spark):
    """A trace that comes in many Arrow batches is filtered as one."""
    rng = np.random.default_rng(0)
    data = [(k, i, float(x), float(y)) for k in range(3) for i, (x, y) in enumerate(rng.normal(0, 50, (40, 2)).cumsum(axis=0))]
    df = spark.createDataFrame(data, "source_id long, record_number int, x double, y double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["source_id"], r["record_number"]): tuple(r)[2:] for r in motion.kalman_offroad(df, 30.0, 100.0, 1e-3).collect()}
        states = {(r["source_id"], r["record_number"]): r["x"] for r in filter_fixes(df, RoadNetwork(grid_edges(spark, 3)), TrackingParameters(particles=3)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        want = [motion.axis_filter(np.array([r[c] for r in data if r[0] == k]), 30.0, 100.0, 1e-3) for c in (2, 3)]
        assert all(got[(k, i)] == pytest.approx((*want[0][i, :2], *want[1][i])) for i in range(40))
    whole = {(r["source_id"], r["record_number"]): r["x"] for r in filter_fixes(df, RoadNetwork(grid_edges(spark, 3)), TrackingParameters(particles=3)).collect()}
    assert states == whole


def test_summaries_may_be_approximate(spark):
    df = spark.range(1000).selectExpr("id % 2 AS k", "double(id) AS v")
    exact, near = (learning.summary(df, "v", ["k"], a).orderBy("k").collect() for a in (None, 10_000))
    assert [r["median"] for r in exact] == [499, 500] and all(abs(a["q3"] - b["q3"]) <= 2 for a, b in zip(exact, near, strict=True))


def test_weights_and_moments(spark):
    df = spark.createDataFrame([(1, -1000.0), (1, -1001.0), (2, 0.0)], "k int, w double")
    got = learning.effective_size(learning.normalised(df, "w", ["k"]), ["k"]).orderBy("k").collect()
    a = 1 / (1 + math.exp(-1))
    assert got[0]["ess"] == pytest.approx(1 / (a * a + (1 - a) ** 2)) and got[1]["ess"] == 1
    m = gaussian.truncated_mean(np.array([0.0, 0.0, 5.0]), np.ones(3), np.array([0.0, 40.0, 0.0]), np.array([np.inf, 50.0, 10.0]))
    assert m[0] == pytest.approx(math.sqrt(2 / math.pi)) and 40 <= m[1] <= 50 and m[2] == pytest.approx(5)
    inf = spark.range(1).select(gaussian.dirichlet_mean(F.lit(float("inf")), F.lit(1.0)), gaussian.dirichlet_mean(F.lit(1.0), F.lit(float("inf"))), gaussian.dirichlet_mean(F.lit(1.0), F.lit(3.0))).first()
    assert list(inf) == [1, 0, 0.25]


def test_empty_tables(spark):
    net = RoadNetwork(grid_edges(spark))
    none = observations.linked(spark.createDataFrame([], "source_id long, ts timestamp, x double, y double"))
    assert none.count() == 0 and net.nearby(none, 10.0).count() == 0
    assert filter_fixes(none, net, TrackingParameters()).count() == 0


def test_distances_by_rounds_equal_searches(spark, monkeypatch):
    edges = grid_edges(spark, 5, 80.0)
    want = sorted(map(tuple, RoadNetwork(edges).within(300.0).collect()))
    monkeypatch.setattr(networks, "BROADCAST_SEGMENTS", 10)
    assert sorted(map(tuple, RoadNetwork(edges).within(300.0).collect())) == want and len(want) > 100


def test_paths_that_do_not_join_up_are_rejected(spark):
    lines = lambda *ps: F.array(*(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in p)) for p in ps))
    one = spark.range(1)
    assert [(p["x"], p["y"]) for p in one.select(paths.built(lines([(0, 0), (1, 0)], [(1, 0), (1, 2)]))).first()[0]] == [(0, 0), (1, 0), (1, 2)]
    with pytest.raises(Exception, match="do not join up"):
        one.select(paths.built(lines([(0, 0), (1, 0)], [(2, 0), (3, 0)]))).collect()


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [
        ([(0, 0), (1, 0)], [(1, 0), (2, 0)], ([(0, 0), (1, 0), (2, 0)], False)),
        ([(1, 0), (2, 0)], [(0, 0), (1, 0)], ([(0, 0), (1, 0), (2, 0)], False)),
        ([(0, 0), (1, 0), (2, 0)], [(1, 0), (2, 0), (3, 0)], ([(0, 0), (1, 0), (2, 0), (3, 0)], False)),
        ([(0, 0), (1, 0), (2, 0)], [(3, 0), (2, 0), (1, 0)], ([(0, 0), (1, 0), (2, 0), (3, 0)], True)),
        ([(0, 0), (1, 0), (2, 0), (3, 0)], [(1, 0), (2, 0)], ([(0, 0), (1, 0), (2, 0), (3, 0)], False)),
        ([(1, 0), (2, 0)], [(3, 0), (2, 0), (1, 0), (0, 0)], ([(0, 0), (1, 0), (2, 0), (3, 0)], True)),
        ([(0, 0), (1, 0)], [(5, 5), (6, 6)], None),
    ],
)
def test_merging_lines(spark, a, b, expected):
    df = spark.createDataFrame([([tuple(map(float, p)) for p in a], [tuple(map(float, p)) for p in b])], f"a {POINTS}, b {POINTS}")
    m = df.select(paths.merged(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert (([(p["x"], p["y"]) for p in m["points"]], m["reversed"]) if m else None) == expected


def test_special_functions_are_exact():
    import statistics

    x = np.concatenate([np.linspace(-6, 26, 400), [0.0]])
    assert gaussian.erfc(x) == pytest.approx(np.array([math.erfc(v) for v in x]), rel=1e-12)
    p = np.concatenate([10.0 ** -np.arange(1, 200, 9), np.linspace(0.001, 0.999, 300)])
    assert gaussian.quantile(p) == pytest.approx(np.array([statistics.NormalDist().inv_cdf(v) for v in p]), rel=1e-12, abs=1e-12)
    far = gaussian.draw_truncated(np.array([0.0, 0.5, 1.0]), np.zeros(3), np.ones(3), np.full(3, 9.0), np.full(3, 9.5))
    assert far[0] == pytest.approx(9.0) and 9.0 < far[1] < 9.2 and far[2] == pytest.approx(9.5)


def test_drawing_from_a_truncated_normal():
    u = (np.arange(2000) + 0.5) / 2000
    x = gaussian.draw_truncated(u, np.full(2000, 1.0), np.full(2000, 2.0), np.full(2000, 0.0), np.full(2000, np.inf))
    assert x.min() >= 0 and x.mean() == pytest.approx(float(gaussian.truncated_mean(np.array([1.0]), np.array([2.0]), np.array([0.0]), np.array([np.inf]))[0]), abs=0.01)


def test_bootstrap_over_many_sources_equals_one_by_one(spark, sf):
    """All sources of a step together give what each gives alone, and no filter is run source by source."""
    from wayfold.operators import fleet

    streets = [(k, k, k + 1, [(100.0 * k, 0.0), (100.0 * k + 60, 0.0), (100.0 * k + 100, 0.0)]) for k in range(4)]
    streets += [(10 + k, k + 1, k + 9, [(100.0 * (k + 1), 0.0), (100.0 * (k + 1), 80.0)]) for k in range(3)] + [(20, 4, 3, [(400.0, 0.0), (300.0, 0.0)])]
    net, params = RoadNetwork(spark.createDataFrame(streets, EDGE_SCHEMA)), TrackingParameters(particles=12, off_probs=(1.0, 3.0), on_probs=(8.0, 2.0))
    rng = np.random.default_rng(5)
    rows = [(s, r, float(x), float(y)) for s in range(7) for r, (x, y) in enumerate(np.cumsum(rng.normal((20 + 5 * s, 2), 15, (9 + s, 2)), axis=0).tolist())]
    fixes = spark.createDataFrame(rows, "source_id long, record_number int, x double, y double").withColumn("more", F.lit("kept"))
    got = {(r["source_id"], r["record_number"]): r for r in filter_fixes(fixes, net, params, "bootstrap").collect()}
    assert len(got) == len(rows) and all(r["more"] == "kept" for r in got.values())
    for s in range(7):
        own = [r for r in rows if r[0] == s]
        for want in filter_trace(net.compact(), params, "bootstrap", s, np.array([r[2:] for r in own]), [r[1] for r in own]):
            row = tuple(got[(s, want[0])][n] for n in NAMES)
            assert row[:4] == want[:4] and row[-2:] == want[-2:]
            assert row[4:-2] == pytest.approx(want[4:-2], rel=1e-12, abs=1e-9) if want[1] else row[6:-2] == pytest.approx(want[6:-2], rel=1e-12, abs=1e-9)
    together = fleet.Fleet(net.compact(), params)
    steps = []
    together._step = lambda slots, *rest, step=together._step: steps.append(len(slots)) or step(slots, *rest)
    for r in range(3):
        together.advance(list(range(7)), list(range(7)), np.array([row[2:] for row in rows if row[1] == r]), [r] * 7)
    assert steps == [7, 7]


@pytest.mark.parametrize("method", ["pl", "path_sampling"])
def test_learning_over_many_sources_equals_one_by_one(spark, method):
    """Sources joined in a step give what each gives alone, and their walks and learning run once for all of them."""
    from wayfold.operators import convoy

    net = crooked()
    params = TrackingParameters(particles=7, off_probs=(2.0, 3.0), on_probs=(8.0, 2.0), path_search_bound=600.0)
    rng = np.random.default_rng(7)
    traces = {s: 200 + np.cumsum(rng.normal(0, 40 + 10 * s, (6 + s, 2)), axis=0) for s in range(5)}
    together, got, calls = convoy.Convoy(net, params, method), {}, []
    together.model._learnt = lambda old, *rest, learn=together.model._learnt: calls.append(len(old)) or learn(old, *rest)
    for r in range(max(map(len, traces.values()))):
        now = [s for s, t in traces.items() if r < len(t)]
        found = together.advance(now, now, np.array([traces[s][r] for s in now]), [r] * len(now))
        for k, s in enumerate(now):
            got[(s, r)] = tuple(found[n][k] for n in NAMES)
    assert calls[:5] == [35] * 5 and len(calls) == max(map(len, traces.values())) - 1
    for s, t in traces.items():
        assert filter_trace(net, params, method, s, t, list(range(len(t)))) == [got[(s, r)] for r in range(len(t))]


def test_fans_follow_least_ways():
    net = crooked()
    for e in range(len(net.edge_len)):
        seg, start, parent, n_own = net.fan(e, 250.0)
        tree = net.tree(int(net.to_node[e]), 250.0)
        assert n_own == net.n_segs[e] and len(seg) == n_own + sum(net.n_segs[f] for node in tree for f in net.out[node])
        for s, d, p in zip(seg[n_own:].tolist(), start[n_own:].tolist(), parent[n_own:].tolist(), strict=True):
            f = int(net.seg_edge[s])
            assert d == pytest.approx(net.edge_len[e] + tree[int(net.from_node[f])][0] + net.start[s])
            assert d == pytest.approx(start[p] + net.seg_len[seg[p]])


@pytest.mark.parametrize("digits", [None, 6])
def test_nearest_equals_ranking_all_near(spark, monkeypatch, digits):
    from wayfold.operators import mapmatch
    from wayfold.operators import network as networks
    from wayfold.plans.queries import crooked_edges

    odd = [None, math.nan, math.inf, -math.inf, 1e300, -1e18, 0.0, 50.0, 1e4]
    rng = np.random.default_rng(3)
    rows = [(x, y) for x in odd for y in odd] + [(100.0 * i, 100.0 * j) for i in range(9) for j in range(9)] + rng.uniform(-200, 900, (300, 2)).tolist()
    points = spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "k int, x double, y double")
    nets = [RoadNetwork(grid_edges(spark, 6)), RoadNetwork(crooked_edges(spark)), RoadNetwork(crooked_edges(spark).where("edge_id < 0"))]
    got = [sorted(map(repr, mapmatch.matched(points, n, 60.0, ["k"], digits).collect())) for n in nets]
    for n in nets:
        n.n_listed(60.0)
    monkeypatch.setattr(networks, "BROADCAST_SEGMENTS", 1)
    assert got == [sorted(map(repr, mapmatch.matched(points, n, 60.0, ["k"], digits).collect())) for n in nets]
    assert len(got[0]) > 50 and not got[2]


def test_movements_of_batches_equal_those_of_rows(spark):
    """The same points, number for number, also of odd paths and distances; and no row by row work where nothing is odd."""
    rng = np.random.default_rng(11)
    lines = [np.cumsum(rng.normal(0, 10, (n, 2)), axis=0).tolist() for n in rng.integers(2, 40, 60)] + [[], [[1.0, 2.0]], None, [[0.0, 0.0], [0.0, 0.0], [3.0, 4.0]], [[0.0, 0.0], [None, 4.0]], [None, [3.0, 4.0], [3.0, 9.0]]]
    ends = [(0.0, 25.0), (10.0, 10.0), (-5.0, 1e9), (30.0, 3.0), (None, 5.0), (5.0, None), (math.nan, 5.0), (5.0, math.nan), (0.0, 5.0), (math.inf, -math.inf)]
    rows = [(k, [None if q is None else tuple(q) for q in p] if p is not None else None, a, b) for k, p in enumerate(lines) for a, b in ends]
    df = spark.createDataFrame(rows, "k int, p array<struct<x: double, y: double>>, a double, b double")
    got = df.select("k", paths.movement(F.col("p"), F.col("a"), F.col("b")).alias("m"), paths._movement(F.col("p"), F.col("a"), F.col("b")).alias("want"), paths._movements("p", "a", "b").alias("fast")).collect()
    assert all(repr(r["m"]) == repr(r["want"]) for r in got)
    assert sum(r["fast"] is not None for r in got) == 61 * 8
