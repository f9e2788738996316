"""Readers, writers and configurations."""

import json
import math

import pytest
from pyspark.sql import functions as F

from wayfold.operators.network import RoadNetwork, grid_edges
from wayfold.params import TrackingParameters
from wayfold.sources import networks, results, traces


def test_trace_without_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c;id;lat;lon;time;v\n")
    assert traces.read_trace(spark, str(tmp_path / "t.csv")).count() == 0


def test_trace_columns_by_place(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a;b;c;id;lat;lon;time;v\n;;;car;40.7;-74.0;2024-01-01 23:00:10;3.5\n;;;car;40.8;-74.0;2024-01-01 23:00:00;\n")
    rows = traces.read_trace(spark, str(tmp_path / "t.csv")).orderBy("record_number").collect()
    assert [(r["source_id"], r["lat"], r["record_number"], r["velocity"], r["epsg"]) for r in rows] == [("car", 40.8, 0, None, 32618), ("car", 40.7, 1, 3.5, 32618)]
    assert rows[0]["ts"].hour == 23 and rows[1]["prev_x"] == rows[0]["x"]


def test_config(tmp_path):
    raw = '{"traceFileName": "t.csv", "initialParameters": {"obsCov": [100, 100], "offTransitionProbs": [1, +Infinity], "numParticles": 25, "initialObsFreq": 30.5, "obsCovDof": 20}}'
    (tmp_path / "c.json").write_text(raw)
    settings, params = traces.read_config(str(tmp_path / "c.json"))
    assert settings == {"traceFileName": "t.csv"} and params.off_probs == (1, math.inf) and params.freq == 30.5 and params.particles == 25
    (tmp_path / "c.json").write_text(raw.replace("100, 100", "NaN"))
    with pytest.raises(ValueError, match="NaN"):
        traces.read_config(str(tmp_path / "c.json"))
    (tmp_path / "c.json").write_text(raw.replace("100, 100", "100, 400"))
    with pytest.raises(ValueError, match="axis"):
        traces.read_config(str(tmp_path / "c.json"))


def test_numbers_and_observations_from_json(spark):
    df = spark.createDataFrame([("[1, 2.5]",), ('{"a": 1}',), (None,)], "t string")
    assert [r[0] for r in df.select(traces.numbers_from_json(F.col("t"))).collect()] == [[1.0, 2.5], None, None]
    with pytest.raises(Exception, match="NaN"):
        spark.createDataFrame([("[NaN]",)], "t string").select(traces.numbers_from_json(F.col("t"))).collect()
    row = traces.observations_from_json(spark.createDataFrame([('{"source_id": "a", "ts": "2024-01-01T00:00:00Z", "lat": 1, "lon": 2}',)], "t string"), "t").first()
    assert (row["source_id"], row["lat"], row["velocity"]) == ("a", 1.0, None)


def test_results_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("veh0", 0, True, 25.0, 1.0, 500_100.0, 0.0, 4_500_000.0, 0.0, [0, 2], "a"), ("veh0", 1, False, None, None, 500_000.0, 0.5, 4_500_000.0, 0.0, None, "b")], "source_id string, record_number int, on_road boolean, dist double, speed double, x double, vx double, y double, vy double, path array<int>, note string")
    net = RoadNetwork(spark.createDataFrame([(0, 0, 1, [(0.0, 0.0), (50.0, 0.0)]), (2, 1, 2, [(50.0, 0.0), (50.0, 30.0), (90.0, 30.0)])], "edge_id int, from_node int, to_node int, geometry array<struct<x: double, y: double>>"))
    results.write_results(df, str(tmp_path / "r"), net, 32618)
    rows = spark.read.json(str(tmp_path / "r")).orderBy("record_number").collect()
    assert rows[0]["state"]["state"] == [25.0, 1.0] and rows[1]["state"]["state"] == [500_000.0, 0.5, 4_500_000.0, 0.0]
    assert rows[0]["state"]["path"] == [[0, 0], [50, 0], [50, 25]] and rows[1]["meanLocation"] == pytest.approx([40.65, -75.0], abs=0.01)
    back = results.read_results(spark, str(tmp_path / "r")).orderBy("record_number").collect()
    assert [(r["source_id"], r["x"], r["y"], r["on_road"]) for r in back] == [("veh0", 500_100.0, 4_500_000.0, True), ("veh0", 500_000.0, 4_500_000.0, False)]
    said = [json.loads(r[0]) for r in df.select(results.state_json(df)).collect()]
    assert said[0]["state"]["state"] == [25.0, 1.0] and said[0]["state"]["path"] is None


def test_from_a_trace_file_to_results(spark, tmp_path):
    """Sources with text ids, streets in degrees; the answers are near the fixes, in degrees, with the points of the path."""
    streets = [(k, [(40.7, -74.0 + 0.001 * k), (40.7, -74.0 + 0.001 * (k + 1))]) for k in range(12)]
    net = networks.from_lines(spark.createDataFrame(streets, "edge_id int, geometry array<struct<lat: double, lon: double>>"), project=True)
    lines = [f";;;{v};40.70001;{-74.0 + 0.0005 + 0.0008 * i + 0.0001 * j};2024-01-01 10:{i // 2:02d}:{30 * (i % 2):02d};2.5" for j, v in enumerate(("veh0", "veh1")) for i in range(9)]
    (tmp_path / "t.csv").write_text("a;b;c;id;lat;lon;time;v\n" + "\n".join(lines) + "\n")
    out = results.track_file(spark, str(tmp_path / "t.csv"), net, TrackingParameters(particles=15, off_probs=(1.0, 99.0), on_probs=(99.0, 1.0)), str(tmp_path / "out"))
    rows = sorted(out.collect(), key=lambda r: (r["source_id"], r["record_number"]))
    assert [(r["source_id"], r["record_number"]) for r in rows] == [(v, i) for v in ("veh0", "veh1") for i in range(9)]
    assert all(r["meanLocation"][0] == pytest.approx(40.7, abs=5e-4) for r in rows)
    assert all(r["meanLocation"][1] == pytest.approx(-74.0 + 0.0005 + 0.0008 * r["record_number"], abs=1e-3) for r in rows)
    on = [r for r in rows if r["on_road"]]
    assert len(on) > 9 and all(r["state"]["path"][-1] == pytest.approx([r["x"], r["y"]], abs=1.5) for r in on)


def test_a_network_behind_a_turn_graph(spark):
    pairs = RoadNetwork(grid_edges(spark, 3))
    e = pairs.edges.select("edge_id", "geometry")
    turns = pairs.outgoing().join(e, "edge_id").join(e.select(F.col("edge_id").alias("out_edge_id"), F.col("geometry").alias("out_geometry")), "out_edge_id")
    built = networks.from_turns(turns)
    assert sorted(map(tuple, built.outgoing().collect())) == sorted(map(tuple, pairs.outgoing().collect()))


def test_networks(spark, tmp_path):
    net = RoadNetwork(grid_edges(spark, 3))
    networks.write_network(net, str(tmp_path / "n"))
    assert networks.read_network(spark, str(tmp_path / "n")).segments.count() == net.segments.count()
    ways = spark.createDataFrame([(1, [10, 11, 12], False, True), (2, [12, 13], True, True), (3, [10, 13], False, False)], "way_id long, node_ids array<long>, one_way boolean, car_ok boolean")
    nodes = spark.createDataFrame([(10, 40.70, -74.0), (11, 40.701, -74.0), (12, 40.702, -74.0), (13, 40.702, -74.001)], "node_id long, lat double, lon double")
    built = networks.from_ways(ways, nodes)
    assert sorted((r["edge_id"], r["way_id"], r["from_osm"], r["to_osm"]) for r in built.edges.collect()) == [(2, 1, 10, 12), (3, 1, 12, 10), (4, 2, 12, 13)]
    assert {(r["edge_id"], r["out_edge_id"]) for r in built.outgoing().collect()} == {(2, 3), (2, 4), (3, 2)}
    turns = spark.createDataFrame([(2, 3, 0.0, True), (2, 4, 100.0, False)], "edge_id long, out_edge_id long, cost double, forbidden boolean")
    seconds = {(r["edge_id"], r["out_edge_id"]): r["seconds"] for r in networks.turn_costs(built, turns).collect()}
    assert set(seconds) == {(2, 4), (3, 2)} and seconds[(2, 4)] == pytest.approx((222.3 + 5) / 15, rel=0.01)


def test_path_points_are_looked_up_row_by_row(spark):
    """No shuffle and no second reading of the results; edges that are not there, and paths without edges, give none."""
    net = RoadNetwork(grid_edges(spark, 3))
    rows = spark.createDataFrame([("a", 0, 30.0, [0, 1]), ("a", 1, 30.0, [0]), ("a", 2, 0.0, None), ("a", 3, 0.0, []), ("a", 4, 1.0, [999])], "source_id string, record_number int, dist double, path array<int>")
    out = results.with_path_points(rows, net)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r["record_number"]: r["path_points"] and [tuple(p) for p in r["path_points"]] for r in out.collect()}
    assert got == {0: [(0, 0), (50, 0), (100, 0), (130, 0)], 1: [(0, 0), (30, 0)], 2: None, 3: None, 4: None}
