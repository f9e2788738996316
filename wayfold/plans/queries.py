"""Named queries: (spark, sf_dir) -> DataFrame, each over the whole ``events`` table or the generated street grid.

Events serve as fixes (`observations.from_events`); the network is an 11 by 11 grid of nodes 100 m apart, every street
in both directions and two segments each. Doubles are rounded to four decimals, without negative zeros.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions import gaussian, geo
from wayfold.functions import geometry as g
from wayfold.operators import learning, mapmatch, motion, observations, paths, transitions
from wayfold.operators.filters import filter_fixes
from wayfold.operators.network import RoadNetwork, grid_edges, search_cost, search_heuristic
from wayfold.operators.simulation import simulate
from wayfold.params import TrackingParameters
from wayfold.sources.networks import turn_costs
from wayfold.sources.results import matrix_json, state_json, with_path_points
from wayfold.sources.traces import numbers_from_json
from wayfold.storage import fresh_path

FREQ, OBS_VAR, ROAD_Q, GROUND_Q = 30.0, 100.0, 6.25e-4, 6.25e-4
#: Search radius; a fix within ``ON_ROAD`` metres of a street counts as on it.
RADIUS, ON_ROAD = 60.0, 25.0
OBS_COV = (100.0, 20.0, 50.0)
PATH_LENGTH, HOPS, BOUND = 250.0, 4, 1620.0
KEY = ["source_id", "record_number"]

#: The filters run with the defaults: 25 particles, searches within 1620 m, radii without a limit.
FILTER = TrackingParameters()
SIMULATION = TrackingParameters(obs_cov=(60.0, 60.0), off_probs=(1.0, 1.0), on_probs=(1.0, 1.0), freq=15.0, seed=21595857)


def r4(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 4) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(r4(c).alias(c) if c in columns else c for c in df.columns))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "value", "props")


def fixes(spark: SparkSession, sf: str) -> DataFrame:
    return observations.displacement_velocity(observations.linked(observations.from_events(events(spark, sf)), "event_id"), FREQ)


@cache
def _grid(spark: SparkSession) -> RoadNetwork:
    return RoadNetwork(grid_edges(spark))


def crooked_edges(spark: SparkSession, n: int = 8) -> DataFrame:
    """Streets between moved grid points, bent in the middle, some of them one-way."""
    nodes = spark.range(n * n).select((F.col("id") % n).cast("int").alias("i"), F.floor(F.col("id") / n).cast("int").alias("j"))
    point = lambda i, j: (100 * i + (7 * i + 13 * j) % 41 - 20, 100 * j + (11 * i + 5 * j) % 37 - 18)
    i, j = F.col("i"), F.col("j")
    ways = [(0, 1, 0, F.lit(True), False), (1, 1, 0, (i + 2 * j) % 5 != 0, True), (2, 0, 1, F.lit(True), False), (3, 0, 1, (3 * i + j) % 4 != 0, True)]
    out = None
    for way, di, dj, there, back in ways:
        a, b = (point(i, j), (i, j)), (point(i + di, j + dj), (i + di, j + dj))
        a, b = (b, a) if back else (a, b)
        middle = ((a[0][0] + b[0][0]) / 2 + (-5 if back else 6), (a[0][1] + b[0][1]) / 2 + (7 if back else -4))
        points = F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (a[0], middle, b[0])))
        rows = nodes.where(there & (i + di < n) & (j + dj < n)).select((way * 100 + i * 10 + j).cast("int").alias("edge_id"), (a[1][0] * n + a[1][1]).cast("int").alias("from_node"), (b[1][0] * n + b[1][1]).cast("int").alias("to_node"), points.alias("geometry"))
        out = rows if out is None else out.unionByName(rows)
    return out


@cache
def _crooked(spark: SparkSession) -> RoadNetwork:
    return RoadNetwork(crooked_edges(spark))


def near(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark).nearby(fixes(spark, sf), RADIUS)


def snapped(spark: SparkSession, sf: str) -> DataFrame:
    return mapmatch.matched(fixes(spark, sf), _grid(spark), RADIUS, KEY)


# -- fixes, projection --------------------------------------------------------------------------------------------


def obs_scan(spark, sf):
    return rounded(fixes(spark, sf).select(*KEY, "event_id", "x", "y", "prev_x", "prev_y"), "x", "y", "prev_x", "prev_y")


def obs_displacement_velocity(spark, sf):
    return rounded(fixes(spark, sf).select(*KEY, "vx", "vy"), "vx", "vy")


def obs_in_extent(spark, sf):
    return observations.in_extent(fixes(spark, sf), _grid(spark).extent()).groupBy("in_extent").count().withColumnRenamed("count", "n")


def _world(spark, sf):
    e = observations.from_events(events(spark, sf))
    return e.select("event_id", (F.col("value") % 160 - 80).alias("lat"), (3.6 * F.col("k") - 180 + F.col("value") % 3.5).alias("lon"))


def utm_zone_epsg(spark, sf):
    return _world(spark, sf).select("event_id", geo.utm_zone(F.col("lon")).alias("zone"), geo.epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def utm_forward(spark, sf):
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    return _world(spark, sf).select("event_id", F.round(x, 2).alias("easting"), F.round(y, 2).alias("northing"))


def utm_roundtrip(spark, sf):
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    rows = _world(spark, sf).select("event_id", "lat", "lon", x.alias("e"), y.alias("n"), geo.epsg(F.col("lat"), F.col("lon")).alias("code"))
    lat, lon = geo.from_utm(F.col("e"), F.col("n"), F.col("code"))
    return rows.select("event_id", (F.abs(lat - F.col("lat")) < 1e-6).alias("lat_ok"), (F.abs(lon - F.col("lon")) < 1e-6).alias("lon_ok"), F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


def metres_to_degrees(spark, sf):
    return fixes(spark, sf).select("event_id", F.round(geo.metres_to_degrees(F.col("x")), 8).alias("degrees"))


# -- network ------------------------------------------------------------------------------------------------------


def graph_segments(spark, sf):
    columns = ("x0", "y0", "x1", "y1", "seg_len", "start_dist", "edge_len")
    return rounded(_grid(spark).segments.select("edge_id", "seg_idx", *columns, "next_seg_idx"), *columns)


def graph_extent(spark, sf):
    return rounded(_grid(spark).extent(), "min_x", "min_y", "max_x", "max_y", "total_len")


def graph_edge_facts(spark, sf):
    facts = _grid(spark).edge_facts()
    return rounded(facts, *facts.columns[1:])


def adjacency_out(spark, sf):
    return _grid(spark).outgoing()


def adjacency_in(spark, sf):
    return _grid(spark).incoming()


def reverse_edges(spark, sf):
    return _grid(spark).reverses()


def same_street(spark, sf):
    return _grid(spark).same_street()


def segments_between(spark, sf):
    return rounded(_grid(spark).segments_between(25.0, 80.0).select("edge_id", "seg_idx", "start_dist"), "start_dist")


def nearby_segments(spark, sf):
    return rounded(near(spark, sf).select(*KEY, "edge_id", "seg_idx", "dist"), "dist")


def paths_to_length(spark, sf):
    return _grid(spark).paths_to_length(PATH_LENGTH).select("start_edge", F.array_join("path", ",").alias("path"), r4("path_len").alias("path_len"))


def edges_at_length(spark, sf):
    return _grid(spark).edges_at_length(PATH_LENGTH)


def node_reach(spark, sf):
    return rounded(_grid(spark).reach(HOPS), "cost")


def candidate_paths(spark, sf):
    """From the state at each fix's predecessor to every edge near the fix: from an edge by the least way within 1620 m
    from its end (``ahead``), or none if it is the same one (``same``); from the ground at once (``onto``); and off the
    road always (``off``)."""
    net, key = _grid(spark), [*KEY, "prev_edge"]
    w = Window.partitionBy("source_id").orderBy("record_number")
    # the near join serves both the state on the road and the goals
    per_fix = near(spark, sf).groupBy(*KEY).agg(F.min(F.struct("dist", "edge_id", "seg_idx")).alias("best"), F.collect_set("edge_id").alias("goals"))
    states = fixes(spark, sf).select(*KEY).join(per_fix, KEY, "left").withColumn("here", F.when(F.col("best.dist") < ON_ROAD, F.col("best.edge_id")))
    steps = states.withColumns({"prev_edge": F.lag("here").over(w)}).where("record_number > 0").select(*key, "goals")
    ends = net.edges.select(F.col("edge_id").alias("prev_edge"), F.col("to_node").alias("node"))
    begins = net.edges.select("edge_id", F.col("from_node").alias("other"))
    none = F.lit(None).cast("double")
    goals = steps.select(*key, F.explode("goals").alias("edge_id"))
    on = goals.join(net.sent(ends), "prev_edge").join(net.sent(begins), "edge_id")
    ahead = on.join(net.within(BOUND), ["node", "other"]).select(*key, "edge_id", F.lit("ahead").alias("kind"), r4("cost").alias("cost"))
    same = goals.where("edge_id = prev_edge").select(*key, "edge_id", F.lit("same").alias("kind"), F.lit(0.0).alias("cost"))
    onto = goals.where("prev_edge is null").select(*key, "edge_id", F.lit("onto").alias("kind"), none.alias("cost"))
    off = steps.select(*key, F.lit(None).cast("int").alias("edge_id"), F.lit("off").alias("kind"), none.alias("cost"))
    return ahead.unionByName(same).unionByName(onto).unionByName(off)


def node_distances(spark, sf):
    """Least lengths between all nodes within 1620 m."""
    return rounded(_grid(spark).within(BOUND), "cost")


def nearby_by_belief(spark, sf):
    """Segments within 2.5 times the root of the norm of each fix's own covariance."""
    wide = F.least(F.lit(RADIUS), 2.5 * F.sqrt((20 + F.col("value") % 100) * F.sqrt(F.lit(2.0))))
    rows = _grid(spark).nearby(fixes(spark, sf), RADIUS, within=wide)
    return rounded(rows.select(*KEY, "edge_id", "seg_idx", "dist"), "dist")


def nearby_open_streets(spark, sf):
    """Near segments of streets that are open to cars (here: two of three)."""
    open_ones = RoadNetwork(_grid(spark).edges.where("edge_id % 3 <> 0"))
    return rounded(open_ones.nearby(fixes(spark, sf), RADIUS).select(*KEY, "edge_id", "seg_idx", "dist"), "dist")


def turn_seconds(spark, sf):
    """Time over each allowed turn; turning back costs, and from every seventh street it is forbidden."""
    net = _grid(spark)
    back = net.reverses().where("has_reverse").select("edge_id", F.col("reverse_edge_id").alias("out_edge_id"), F.lit(60.0).alias("cost"), (F.col("edge_id") % 7 == 0).alias("forbidden"))
    return rounded(turn_costs(net, back), "seconds")


def search_costs(spark, sf):
    """Cost and heuristic of a path search that reaches each fix's segment, for the distance travelled since the last."""
    rows = snapped(spark, sf)
    travelled = F.lit(FREQ) * F.abs("vx")
    return rows.select(*KEY, r4(search_cost(travelled, F.col("seg_len"), F.col("along"))).alias("cost"), r4(search_heuristic(F.col("dist"), F.lit(10.0))).alias("heuristic"))


def crooked_facts(spark, sf):
    facts = _crooked(spark).edge_facts()
    return rounded(facts, *facts.columns[1:])


def crooked_snap(spark, sf):
    """The closest of the crooked streets' segments to each fix."""
    rows = mapmatch.matched(fixes(spark, sf), _crooked(spark), RADIUS, KEY, digits=6)  # streets meet in nodes
    rows = mapmatch.road_observation(rows, *OBS_COV)
    return rounded(rows.select(*KEY, "edge_id", "seg_idx", "dist", "along", "road_var"), "along", "road_var")


def crooked_distances(spark, sf):
    return rounded(_crooked(spark).within(600.0), "cost")


def crooked_walks(spark, sf):
    rows = _crooked(spark).paths_to_length(PATH_LENGTH)
    return rows.select("start_edge", F.array_join("path", ",").alias("path"), r4("path_len").alias("path_len"))


def walk_geometry(spark, sf):
    """Lines of all walks up to a length, put together: points, length, whether they join up, also in reverse order."""
    walks = paths.geometry_of(_crooked(spark).paths_to_length(PATH_LENGTH), _crooked(spark))
    whole = walks.withColumn("points", paths.built(F.col("lines")))
    return whole.select("start_edge", F.array_join("path", ",").alias("path"), F.size("points").alias("n_points"), r4(g.line_length(F.col("points"))).alias("length"), paths.contiguous(F.col("lines")).alias("joins"), paths.contiguous(F.reverse("lines")).alias("joins_back"))


# -- states on paths ----------------------------------------------------------------------------------------------


def _on_streets(spark, sf):
    """Each fix on the street that it was snapped to, at a distance d that may lie beyond it."""
    net = _grid(spark)
    s = net.by_id(snapped(spark, sf).select(*KEY, "edge_id", "value"), "edge_id")
    return s.select(*KEY, "edge_id", F.col("edge_geometry").alias("points"), (F.col("value") % 130 - 15).alias("d"))


def path_tests(spark, sf):
    length, no, zero = F.lit(100.0), F.lit(False), F.lit(0.0)
    d, yes = F.col("d"), F.lit(True)
    out = {
        "clamped": r4(paths.clamp(d, length, no)), "clamped_back": r4(paths.clamp(d - 100, length, yes)), "arc_back": r4(paths.arc(d - 100, length, yes)), "on_path": paths.on_path(d, length, no),
        "on_edge": paths.on_edge(d, zero, length), "checked": r4(paths.checked_on_edge(d, zero, length)), "nudged": F.round(paths.clamp_to_edge(d, zero, length), 6), "piece": paths.edge_at(F.col("points"), paths.clamp(d, length, no)),
    }
    return _on_streets(spark, sf).select(*KEY, *(c.alias(n) for n, c in out.items()))


def movements(spark, sf):
    """The part of a street travelled between two distances, and the parts up to the first and from the second piece."""
    a, b = F.lit(10.0), paths.clamp(F.col("d"), F.lit(100.0), F.lit(False))
    rows = _on_streets(spark, sf).where("d > 10").withColumns({"m": paths.movement(F.col("points"), a, b), "upto": paths.path_to(F.col("points"), b), "rest": paths.path_from(F.col("points"), F.lit(1))})
    end = lambda k, c: r4(F.element_at("m", k)[c])
    return rows.select(*KEY, F.size("m").alias("n_points"), end(1, "x").alias("x0"), end(1, "y").alias("y0"), end(-1, "x").alias("x1"), end(-1, "y").alias("y1"), r4(g.line_length(F.col("m"))).alias("length"), r4(g.line_length(F.col("upto"))).alias("upto"), r4(g.line_length(F.col("rest"))).alias("rest"))


def state_algebra(spark, sf):
    """Sums, products and norms of road states, and a speed as seen along the street before."""
    w = Window.partitionBy("source_id").orderBy("record_number")
    s = snapped(spark, sf).select(*KEY, "along", "vx", "x0", "y0", "x1", "y1")
    rows = s.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("along", "vx", "x0", "y0", "x1", "y1"))).where("p_along is not null")
    here, there = (F.col("along"), F.col("vx")), (F.col("p_along"), F.col("p_vx"))
    total, half = paths.plus(here, there), paths.plus(here, there, -0.5)
    seen = paths.against(F.col("vx"), F.col("p_x1") - F.col("p_x0"), F.col("p_y1") - F.col("p_y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rows.select(*KEY, r4(total[0]).alias("sum_d"), r4(total[1]).alias("sum_v"), r4(half[0]).alias("half_d"), r4(half[1]).alias("half_v"), r4(paths.dot(here, there)).alias("dot"), r4(paths.norm(here)).alias("norm"), r4(seen).alias("seen"))


def state_order(spark, sf):
    """The place of each fix's road state among its source's: by path, then distance, then speed."""
    net = _grid(spark)
    s = net.by_id(snapped(spark, sf).select(*KEY, "edge_id", "along", "vx"), "edge_id")
    order = paths.ordered(F.col("edge_geometry"), F.round("along", 6), F.round("vx", 6))
    return s.select(*KEY, F.row_number().over(Window.partitionBy("source_id").orderBy(order, "record_number")).alias("place"))


# -- road and ground ----------------------------------------------------------------------------------------------


def snap_nearest(spark, sf):
    return rounded(snapped(spark, sf).select(*KEY, "edge_id", "seg_idx", "dist", "snap_x", "snap_y", "along"), "dist", "snap_x", "snap_y", "along")


def road_observation(spark, sf):
    return rounded(mapmatch.road_observation(snapped(spark, sf), *OBS_COV).select(*KEY, "edge_id", "road_obs", "road_var"), "road_obs", "road_var")


def ground_from_road(spark, sf):
    rows = mapmatch.ground_from_road(snapped(spark, sf), F.col("along"), F.col("vx") - F.col("vy"))
    return rounded(rows.select(*KEY, "gx", "gvx", "gy", "gvy"), "gx", "gvx", "gy", "gvy")


def road_from_ground(spark, sf):
    rows = mapmatch.road_from_ground(snapped(spark, sf), *map(F.col, ("x", "vx", "y", "vy")))
    return rounded(rows.select(*KEY, "road_d", "road_v"), "road_d", "road_v")


def covariance_projection(spark, sf):
    rows = snapped(spark, sf)
    a, b, c = map(F.lit, OBS_COV)
    c00, c01, c11 = (F.lit(v) for v in motion.initial_covariance(OBS_VAR, FREQ))
    ground = mapmatch.ground_covariance(c00, c01, c11)
    return rows.select(*KEY, r4(mapmatch.road_covariance(a, b, c)).alias("road_var"), *(r4(v).alias(f"g{k}") for k, v in enumerate(ground)))


def ground_belief(spark, sf):
    """Road states with their beliefs on the ground, by axes alike."""
    c = [F.lit(v) for v in motion.initial_covariance(OBS_VAR, FREQ)]
    rows = mapmatch.ground_from_road(snapped(spark, sf), F.col("along"), F.col("vx"), absolute=True)
    return rounded(rows.select(*KEY, "gx", "gvx", "gy", "gvy", *(v.alias(f"g{k}") for k, v in enumerate(mapmatch.ground_belief(*c)))), "gx", "gvx", "gy", "gvy", *(f"g{k}" for k in range(10)))


def road_belief(spark, sf):
    """Beliefs on the ground as seen on the nearest street, with the speed of the displacement since the fix before."""
    c = [F.lit(v) for v in motion.initial_covariance(OBS_VAR, FREQ)]
    rows = mapmatch.road_belief(snapped(spark, sf).where("prev_x is not null"), *map(F.col, ("x", "vx", "y", "vy")), c, (F.col("prev_x"), F.col("prev_y"), FREQ))
    return rounded(rows.select(*KEY, "road_d", "road_v", "road_c00", "road_c01", "road_c11"), "road_d", "road_v", "road_c00", "road_c01", "road_c11")


def state_diff(spark, sf):
    """Each two successive fixes as road states on the streets they lie on: one minus the other, where the streets share
    an end piece or meet."""
    net = _grid(spark)
    w = Window.partitionBy("source_id").orderBy("record_number")
    s = net.by_id(snapped(spark, sf).select(*KEY, "edge_id", "along", "vx"), "edge_id")
    s = s.select(*KEY, "edge_id", "along", "vx", F.col("edge_geometry").alias("points"))
    pair = s.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in ("edge_id", "along", "vx", "points"))).where("p_edge_id is not null")
    no = F.lit(False)
    d, v = paths.difference(*map(F.col, ("points", "along", "vx")), no, *map(F.col, ("p_points", "p_along", "p_vx")), no)
    return pair.select(*KEY, r4(d).alias("d"), r4(v).alias("v"))


# -- motion, likelihoods ------------------------------------------------------------------------------------------


def kalman_predict(spark, sf):
    rows = motion.predict(fixes(spark, sf), FREQ, motion.initial_covariance(OBS_VAR, FREQ), GROUND_Q)
    columns = ("px", "pvx", "py", "pvy", "p00", "p01", "p11")
    return rounded(rows.select(*KEY, *columns), *columns)


def kalman_filter_offroad(spark, sf):
    rows = motion.kalman_offroad(fixes(spark, sf), FREQ, OBS_VAR, GROUND_Q)
    return rounded(rows, "x", "vx", "y", "vy", "c00", "c01", "c11")


def obs_loglik(spark, sf):
    """Of each fix under the prediction from the two before it."""
    w = Window.partitionBy("source_id").orderBy("record_number")
    p00 = motion.predicted_covariance(motion.initial_covariance(OBS_VAR, FREQ), FREQ, GROUND_Q)[0]
    rows = fixes(spark, sf).withColumns({"pvx": F.lag("vx").over(w), "pvy": F.lag("vy").over(w)}).where("record_number > 0")
    px, py = F.col("prev_x") + FREQ * F.col("pvx"), F.col("prev_y") + FREQ * F.col("pvy")
    return rows.select(*KEY, r4(motion.observation_log_likelihood(F.col("x"), F.col("y"), px, py, F.lit(p00 + OBS_VAR))).alias("loglik"))


def edge_predictive(spark, sf):
    """Road state of each fix given that it lies on the edge that it was snapped to."""
    c = [F.lit(v) for v in motion.predicted_covariance(motion.initial_covariance(OBS_VAR, FREQ), FREQ, ROAD_Q)]
    rows = snapped(spark, sf)
    out = motion.edge_predictive(F.col("along") + F.abs(F.col("vx")), F.abs(F.col("vx")), *c, F.col("start_dist"), F.col("seg_len"), FREQ)
    return rows.select(*KEY, "edge_id", *(r4(v).alias(n) for n, v in zip(("d", "v", "c00", "c01", "c11"), out, strict=True)))


def truncated_mean(spark, sf):
    rows = snapped(spark, sf)
    return rows.select(*KEY, F.round(gaussian.truncated_normal_mean(F.col("along"), F.lit(10.0), F.lit(0.0), F.col("edge_len")), 4).alias("mean"))


def folded_mean(spark, sf):
    """Mean of the distance law on [0, inf) about each fix's distance from its street, with the sign of its speed."""
    rows = snapped(spark, sf)
    return rows.select(*KEY, F.round(gaussian.folded_normal_mean(F.col("along") - 50, F.lit(20.0)), 4).alias("mean"))


def truncated_sample(spark, sf):
    """The distance below which a share of the law on the street lies: the share, back from that distance."""
    u = (F.col("record_number") % 97 + 0.5) / 97
    rows = snapped(spark, sf).withColumn("q", gaussian.truncated_quantile(u, F.col("along"), F.lit(12.0), F.lit(0.0), F.col("edge_len")))
    return rows.select(*KEY, F.round("q", 4).alias("q"))


def dirichlet_density(spark, sf):
    """Log density of the prior of staying on the road, at each source's share of steps that did."""
    c = transition_counts(spark, sf).withColumn("p", (F.col("on_on") + 1) / (F.col("on_on") + F.col("on_off") + 2))
    return c.select("source_id", F.round(gaussian.dirichlet_log_density("p", F.lit(95.0), F.lit(5.0)), 4).alias("log_density"))


# -- switching, learning ------------------------------------------------------------------------------------------


def on_off(spark, sf):
    """Every fix with the edge that it is on, null off the road."""
    s = snapped(spark, sf).where(F.col("dist") < ON_ROAD).select(*KEY, "edge_id", "seg_idx", "dist", "snap_x", "snap_y")
    return fixes(spark, sf).join(s, KEY, "left")


def transition_counts(spark, sf):
    return transitions.counts(transitions.typed(on_off(spark, sf)))


def dirichlet_mean(spark, sf):
    rows = transitions.posterior_means(transition_counts(spark, sf), (95.0, 5.0), (5.0, 95.0))
    return rounded(rows.select("source_id", "p_on_on", "p_off_off"), "p_on_on", "p_off_off")


def transition_domain(spark, sf):
    return transitions.domain(on_off(spark, sf).select(*KEY, "edge_id", "x", "y"), _grid(spark), RADIUS, 150.0)


def likely_moves(spark, sf):
    """The likelier next motion of each fix, by its source's posterior means over all its fixes."""
    p = transitions.posterior_means(transition_counts(spark, sf), (95.0, 5.0), (5.0, 95.0)).select("source_id", "p_on_on", "p_off_off")
    rows = on_off(spark, sf).select(*KEY, "edge_id").join(p, "source_id")
    moves = transitions.most_likely_move(rows, F.col("p_on_on"), F.col("p_off_off"))
    return moves.select(*KEY, "next_on_road", r4("p_next").alias("p_next"))


def mean_next_edge(spark, sf):
    """The mean of the transition law of each fix."""
    return transitions.mean_edge(transition_domain(spark, sf), likely_moves(spark, sf))


def uturn_logprob(spark, sf):
    w = Window.partitionBy("source_id").orderBy("record_number")
    segment = ("edge_id", "seg_idx", "x0", "y0", "x1", "y1", "edge_len")
    s = snapped(spark, sf).select(*KEY, *segment)
    rows = s.select("*", *(F.lag(c).over(w).alias(f"prev_{c}") for c in segment))
    return rows.select(*KEY, r4(transitions.turn_log_probability()).alias("logprob"))


def inverse_gamma_running(spark, sf):
    s = snapped(spark, sf)
    rows = learning.inverse_gamma_running(s, F.col("dist") * F.col("dist"), 20.0, OBS_VAR * 19.0)
    # sums of squares of centimetres end in the fifth decimal: more decimals keep clear of ties
    return rows.select(*KEY, "ig_shape", F.round("ig_scale", 6).alias("ig_scale"), F.round("ig_mean", 9).alias("ig_mean"))


def _weighted(spark, sf):
    log_w = gaussian.normal_log(F.col("dist"), F.lit(0.0), F.lit(OBS_VAR))
    rows = _grid(spark).nearby(observations.dealt(fixes(spark, sf), KEY), RADIUS)
    return learning.normalised(rows.withColumn("log_w", log_w), "log_w", KEY)


def mixture_normalise(spark, sf):
    return rounded(_weighted(spark, sf).select(*KEY, "edge_id", "seg_idx", "log_total", "weight"), "log_total", "weight")


def ess_by_fix(spark, sf):
    return rounded(learning.effective_size(_weighted(spark, sf), KEY), "ess")


def best_state(spark, sf):
    best = learning.best_state(_weighted(spark, sf).withColumn("log_w", F.round("log_w", 6)), KEY, ["edge_id", "seg_idx"])
    return rounded(best, "log_w")


def mixture_mean(spark, sf):
    rows = _weighted(spark, sf).withColumn("place", F.col("start_dist") + g.along(F.col("x"), F.col("y"), *map(F.col, mapmatch.SEGMENT)))
    return rounded(learning.mixture_mean(rows, KEY, "edge_id", "place"), "edge_weight", "mean")


def truncated_density(spark, sf):
    """Log density of each fix's distance along its edge under a law on the edge's first 80 metres."""
    rows = snapped(spark, sf)
    out = gaussian.truncated_log_density(F.col("along"), 50 + F.col("vx"), F.lit(OBS_VAR), F.lit(0.0), F.lit(80.0))
    v = gaussian.speed_given_distance(F.col("along"), F.lit(50.0), F.abs("vx"), *(F.lit(c) for c in motion.initial_covariance(OBS_VAR, FREQ)[:2]))
    return rows.select(*KEY, F.when(out == float("-inf"), F.lit(None).cast("double")).otherwise(r4(out)).alias("log_density"), r4(v).alias("v"))


def routes(spark, sf):
    """Least way between the ends of the edges of two successive fixes, within two kilometres."""
    net, w = _grid(spark), Window.partitionBy("source_id").orderBy("record_number")
    s = net.by_id(snapped(spark, sf).select(*KEY, "edge_id"), "edge_id").select(*KEY, F.lag("edge_to_node").over(w).alias("node"), F.col("edge_from_node").alias("other"))
    found = net.routes(s.where("node is not null"), 2_000.0)
    return found.select(*KEY, "node", "other", F.size("way").alias("n_edges"), r4("length").alias("length"))


def merged_streets(spark, sf):
    """Each edge with each that leaves its end: one line, and whether the second runs back over the first."""
    net = _grid(spark)
    pairs = net.by_id(net.by_id(net.outgoing(), "edge_id").select("edge_id", "out_edge_id", F.col("edge_geometry").alias("a")), "out_edge_id").select("edge_id", "out_edge_id", "a", F.col("edge_geometry").alias("b"))
    rows = pairs.withColumn("m", paths.merged(F.col("a"), F.col("b")))
    return rows.select("edge_id", "out_edge_id", F.size("m.points").alias("n_points"), r4(g.line_length(F.col("m.points"))).alias("length"), F.col("m.reversed").alias("reversed"))


def longest_paths(spark, sf):
    """Of the walks up to a length, those that no other continues."""
    walks = _grid(spark).paths_to_length(PATH_LENGTH).select("path")
    starts = walks.select(F.slice("path", 1, 2).alias("path")).distinct()
    return paths.without_prefixes(walks.unionAll(starts)).select(F.array_join("path", ",").alias("path"))


def edge_weights(spark, sf):
    rows = learning.counted_weights(_weighted(spark, sf).select("edge_id", "weight", F.lit(1).alias("n")), ["edge_id"])
    return rounded(rows, "weight")


def rmse(spark, sf):
    return rounded(learning.rmse(snapped(spark, sf), F.col("dist") * F.col("dist"), ["source_id"]), "rmse")


def onoff_agreement(spark, sf):
    rows = on_off(spark, sf)
    return rounded(learning.agreement(rows, F.col("edge_id").isNotNull(), F.col("value") % 2 < 1, ["source_id"]), "agreement")


def distance_summary(spark, sf):
    rows = snapped(spark, sf).withColumn("way", F.floor(F.col("edge_id") / 110).cast("int"))
    return rounded(learning.summary(rows, "dist", ["way"]), "least", "q1", "median", "q3", "most", "mean", "sd")


def error_statistics(spark, sf):
    """Mean and covariance of the snapping errors by source."""
    e = snapped(spark, sf).select("source_id", (F.col("x") - F.col("snap_x")).alias("ex"), (F.col("y") - F.col("snap_y")).alias("ey"))
    rows = e.groupBy("source_id").agg(F.avg("ex").alias("mean_x"), F.avg("ey").alias("mean_y"), F.covar_samp("ex", "ex").alias("cxx"), F.covar_samp("ex", "ey").alias("cxy"), F.covar_samp("ey", "ey").alias("cyy"))
    return rounded(rows, "mean_x", "mean_y", "cxx", "cxy", "cyy")


def state_text(spark, sf):
    s = on_off(spark, sf).select(*KEY, F.col("edge_id").isNotNull().alias("on_road"), F.col("dist"), F.col("vx").alias("speed"), "x", "vx", "y", "vy")
    return s.select(*KEY, state_json(s).alias("json"))


# -- order-dependent and random parts -----------------------------------------------------------------------------


def _filtered(method: str):
    def run(spark, sf):
        return filter_fixes(fixes(spark, sf), _grid(spark), FILTER, method)

    run.__name__ = f"{method}_filter"
    return run


def simulated(spark, sf):
    return simulate(spark, _grid(spark), SIMULATION, 64, 120)


def simulate_exact(spark, sf):
    """Vehicles without noise on a square loop of 400 m: vehicle k goes k metres a second from its first corner."""
    corners = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0)]
    edges = [(k, k, (k + 1) % 4, [corners[k], corners[(k + 1) % 4]]) for k in range(4)]
    net = RoadNetwork(spark.createDataFrame(edges, "edge_id int, from_node int, to_node int, geometry array<struct<x: double, y: double>>").coalesce(1))
    calm = TrackingParameters(obs_cov=(0.0, 0.0), on_road_cov=(0.0,), off_road_cov=(0.0, 0.0), off_probs=(1.0, float("inf")), on_probs=(float("inf"), 1.0), freq=7.0)
    rows = simulate(spark, net, calm, 48, 100, start=(50.0, 0.0), speed=1.0)
    return rounded(rows.select("source_id", "record_number", "t_ms", "x", "y", "true_on_road", "true_speed", "true_x", "true_y"), "x", "y", "true_speed", "true_x", "true_y")


def csv_roundtrip(spark, sf):
    """Fixes written as a trace and read again, with their number and sums by source."""
    from wayfold.sources.traces import read_trace

    rows = read_trace(spark, _trace(spark, sf))
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.max("record_number").alias("last"), F.round(F.sum("lat"), 3).alias("lat"), F.round(F.sum("lon"), 3).alias("lon"))


def _trace(spark, sf):
    from wayfold.sources.traces import write_trace

    path = fresh_path(spark, "trace")
    f = fixes(spark, sf).select(F.concat(F.lit("veh"), "source_id").alias("source_id"), "ts", (40.7 + F.col("y") / 111_000).alias("lat"), (-74.0 + F.col("x") / 111_000).alias("lon"), F.col("vx").alias("velocity"))
    write_trace(f.withColumn("ts", F.col("ts").cast("timestamp")), path)
    return path


def trace_run(spark, sf):
    """From a trace file through a filter to result objects and back; the streets are the grid's in degrees."""
    from wayfold.sources.networks import from_lines
    from wayfold.sources.results import track_file

    lines = _grid(spark).edges.select("edge_id", F.transform("geometry", lambda p: F.struct((40.7 + p["y"] / 111_000).alias("lat"), (-74.0 + p["x"] / 111_000).alias("lon"))).alias("geometry"))
    return track_file(spark, _trace(spark, sf), from_lines(lines, project=True), FILTER, fresh_path(spark, "results"), "bootstrap")


def result_paths(spark, sf):
    """The points of a path of two streets up to a fix's place on the second one, as text."""
    net = _grid(spark)
    s = snapped(spark, sf).select(*KEY, "edge_id", F.col("along").alias("dist"))
    before = net.incoming().groupBy("edge_id").agg(F.min("in_edge_id").alias("in_edge_id"))
    rows = s.join(net.sent(before), "edge_id").select(*KEY, "dist", F.array("in_edge_id", "edge_id").alias("path"))
    pointed = with_path_points(rows, net)
    return pointed.select(*KEY, matrix_json(F.transform("path_points", lambda p: F.array(p["x"], p["y"]))).alias("json"))


def geometry_roundtrip(spark, sf):
    """Streets in degrees, projected point by point and taken back."""
    degrees = F.transform("geometry", lambda p: F.struct((40.7 + p["y"] / 111_000).alias("lat"), (-74.0 + p["x"] / 111_000).alias("lon")))
    rows = _grid(spark).edges.select("edge_id", geo.project_points(degrees, F.lit(18)).alias("points"))
    back = rows.select("edge_id", F.size("points").alias("n"), geo.invert_points(F.col("points"), F.lit(32618)).alias("p"))
    return back.select("edge_id", "n", *(F.round(F.element_at("p", k)[c], 5).alias(f"{c}_{name}") for k, name in ((1, "from"), (-1, "to")) for c in ("lat", "lon")))


def covariance_json(spark, sf):
    """A belief's covariance as a matrix in JSON, and the sum of its numbers read back."""
    v = F.col("value") % 50
    rows = events(spark, sf).select("event_id", matrix_json(F.array(F.array(v + 1, v / 4), F.array(v / 4, v + 2))).alias("json"))
    numbers = numbers_from_json(F.concat(F.lit("["), F.regexp_replace("json", r"[\[\]]", ""), F.lit("]")))
    return rows.select("event_id", "json", r4(F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)).alias("total"))


def stream_filter(spark, sf):
    """The bootstrap filter over the events as a stream, replayed to the end."""
    from wayfold.streaming.tracking import track_stream

    path = fresh_path(spark, "stream")
    raw = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parque[t]")
    tracked = track_stream(observations.from_events(raw), _grid(spark), FILTER, "bootstrap")
    query = tracked.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/out")


QUERIES = {
    f.__name__: f
    for f in (
        obs_scan, obs_displacement_velocity, obs_in_extent, utm_zone_epsg, utm_forward, utm_roundtrip, metres_to_degrees,
        graph_segments, graph_extent, graph_edge_facts, adjacency_out, adjacency_in, reverse_edges, same_street, segments_between, nearby_segments,
        paths_to_length, edges_at_length, node_reach, candidate_paths, node_distances, nearby_by_belief, nearby_open_streets, turn_seconds, search_costs,
        crooked_facts, crooked_snap, crooked_distances, crooked_walks, walk_geometry, path_tests, movements, state_algebra, state_order, ground_belief, road_belief,
        folded_mean, truncated_sample, dirichlet_density, mean_next_edge, simulate_exact, result_paths, geometry_roundtrip, covariance_json, trace_run,
        snap_nearest, road_observation, ground_from_road, road_from_ground, covariance_projection, state_diff,
        kalman_predict, kalman_filter_offroad, obs_loglik, edge_predictive, truncated_mean,
        transition_counts, dirichlet_mean, transition_domain, likely_moves, uturn_logprob, inverse_gamma_running, mixture_normalise, ess_by_fix, best_state, edge_weights, mixture_mean, truncated_density, routes, merged_streets, longest_paths,
        rmse, onoff_agreement, distance_summary, error_statistics, csv_roundtrip, stream_filter,
    )
} | {"state_json": state_text, "simulate": simulated, "pl_filter": _filtered("pl"), "path_sampling_filter": _filtered("path_sampling"), "bootstrap_filter": _filtered("bootstrap")}

