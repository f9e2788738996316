"""Road networks from line strings, from way and node tables, and as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.network import RoadNetwork


def from_lines(lines: DataFrame, project: bool = False) -> RoadNetwork:
    """From edge_id and geometry (array of struct(x, y), or of struct(lat, lon) to be projected into the zone of the
    extent's centre). Lines that are null or have under two points are left out. Nodes are numbered by their place."""
    lines = lines.where(F.col("geometry").isNotNull() & (F.size("geometry") > 1))
    if project:
        p = lines.select(F.explode("geometry").alias("p")).agg(*(f(f"p.{c}").alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max)))).first()
        zone = min(60, int(((p["min_lon"] + p["max_lon"]) / 2 + 180) // 6) + 1) if p["min_lon"] is not None else 1
        lines = lines.withColumn("geometry", geo.project_points(F.col("geometry"), F.lit(zone)))
    ends = lines.withColumns({"a": F.get("geometry", F.lit(0)), "b": F.element_at("geometry", -1)})
    number = lambda p: F.xxhash64(p["x"], p["y"])
    rest = [c for c in lines.columns if c not in ("edge_id", "geometry", "from_node", "to_node")]
    edges = ends.select("edge_id", number(F.col("a")).alias("from_node"), number(F.col("b")).alias("to_node"), "geometry", *rest)
    return RoadNetwork(edges)


def from_ways(ways: DataFrame, nodes: DataFrame) -> RoadNetwork:
    """From ways (way_id, node_ids array, one_way, car_ok) and nodes (node_id, lat, lon): each way between its first and
    last node, with the reverse unless it is one-way; only ways open to cars. Edges keep the way's id and those of its
    first and last nodes (way_id, from_osm, to_osm)."""
    legs = ways.where("car_ok").select("way_id", "one_way", F.posexplode("node_ids").alias("at", "node_id"))
    placed = legs.join(nodes, "node_id").groupBy("way_id", "one_way").agg(F.sort_array(F.collect_list(F.struct("at", "lat", "lon", "node_id"))).alias("points"))
    geometry = F.transform("points", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    first, last = F.get("points", F.lit(0))["node_id"], F.element_at("points", -1)["node_id"]
    there = placed.select((2 * F.col("way_id")).alias("edge_id"), geometry.alias("geometry"), "way_id", first.alias("from_osm"), last.alias("to_osm"))
    back = placed.where("not one_way").select((2 * F.col("way_id") + 1).alias("edge_id"), F.reverse(geometry).alias("geometry"), "way_id", last.alias("from_osm"), first.alias("to_osm"))
    return from_lines(there.unionByName(back), project=True)


def from_turns(turns: DataFrame, project: bool = False) -> RoadNetwork:
    """The street network behind a turn graph. ``turns``: one row per allowed turn, with the street it leaves (edge_id,
    geometry) and the one it enters (out_edge_id, out_geometry); streets come up in many turns and are taken once."""
    streets = turns.select("edge_id", "geometry").unionByName(turns.select(F.col("out_edge_id").alias("edge_id"), F.col("out_geometry").alias("geometry")))
    return from_lines(streets.where("edge_id is not null").dropDuplicates(["edge_id"]), project)


def write_network(network: RoadNetwork, path: str) -> None:
    network.edges.write.parquet(path)


def read_network(spark: SparkSession, path: str) -> RoadNetwork:
    return RoadNetwork(spark.read.parquet(path))


def turn_costs(network: RoadNetwork, turns: DataFrame, speed: float = 15.0) -> DataFrame:
    """(edge_id, out_edge_id, seconds) over allowed turns: (length + turn cost / 20) / speed. ``turns`` (edge_id,
    out_edge_id, cost, forbidden) lists those that are not plain."""
    length = network.edge_facts().select("edge_id", "length")
    allowed = network.outgoing().join(turns, ["edge_id", "out_edge_id"], "left").where(~F.coalesce("forbidden", F.lit(False)))
    return allowed.join(length, "edge_id").select("edge_id", "out_edge_id", ((F.col("length") + F.coalesce("cost", F.lit(0.0)) / 20) / speed).alias("seconds"))
