"""Results as JSON: the mean place, the state and the path of each fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.functions import geometry as g
from wayfold.operators import network as networks
from wayfold.operators.filters import filter_fixes
from wayfold.operators.network import RoadNetwork
from wayfold.operators.paths import built, contiguous, geometry_of, looked_up, path_to
from wayfold.params import TrackingParameters
from wayfold.sources.traces import read_trace
from wayfold.storage import kept


def _fixed(value: Column) -> Column:
    """Four decimals; the same text on every engine."""
    return F.format_string("%.4f", F.round(value, 4) + F.lit(0.0))


def state_json(rows: DataFrame, path: Column | None = None) -> Column:
    """Text of one result: meanLocation (place), state (road: distance and speed; ground: x, vx, y, vy), stateLoc, and
    the path's points or null. Columns: on_road, dist, speed, x, vx, y, vy."""
    place = F.concat(F.lit("["), _fixed(F.col("x")), F.lit(","), _fixed(F.col("y")), F.lit("]"))
    road = F.concat(F.lit("["), _fixed(F.col("dist")), F.lit(","), _fixed(F.col("speed")), F.lit("]"))
    ground = F.concat(F.lit("["), F.concat_ws(",", *(_fixed(F.col(c)) for c in ("x", "vx", "y", "vy"))), F.lit("]"))
    points = F.lit("null") if path is None else F.coalesce(F.concat(F.lit("["), F.array_join(F.transform(path, lambda p: F.concat(F.lit("["), _fixed(p["x"]), F.lit(","), _fixed(p["y"]), F.lit("]"))), ","), F.lit("]")), F.lit("null"))
    return F.concat(F.lit('{"meanLocation":'), place, F.lit(',"state":{"state":'), F.when(F.col("on_road"), road).otherwise(ground), F.lit(',"stateLoc":'), place, F.lit(',"path":'), points, F.lit("}}"))


def with_mean_location(results: DataFrame, epsg: Column) -> DataFrame:
    """Adds lat, lon of projected results."""
    lat, lon = geo.from_utm(F.col("x"), F.col("y"), epsg)
    return results.withColumns({"lat": lat, "lon": lon})


def matrix_json(rows: Column) -> Column:
    """A matrix (array of arrays of numbers), or a vector, as JSON text with four decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, _fixed), ","), F.lit("]"))), ","), F.lit("]"))


def with_path_points(results: DataFrame, network: RoadNetwork) -> DataFrame:
    """Adds path_points: the points of the path (edge ids) of each result up to its state, null off the road. Results are
    told apart by source_id and record_number where the network is too large to be sent; they are kept then, as they are
    read twice."""
    key = ["source_id", "record_number"]
    sent = network.n_segments <= networks.BROADCAST_SEGMENTS
    if sent:
        lines = looked_up(results, network)
    else:
        results = kept(results)
        lines = geometry_of(results.where(F.size("path") > 0).select(*key, "path", "dist"), network)
    whole = F.when(contiguous(F.col("lines")), built(F.col("lines")))
    before = F.aggregate(F.slice("lines", 1, F.greatest(F.lit(0), F.size("lines") - 1)), F.lit(0.0), lambda a, p: a + g.line_length(p))
    lines = lines.withColumns({"_whole": whole, "_at": before + F.col("dist")})
    if sent:
        return lines.select(*results.columns, F.when(F.size("lines") > 0, path_to(F.col("_whole"), F.col("_at"))).alias("path_points"))
    points = lines.select(*key, path_to(F.col("_whole"), F.col("_at")).alias("path_points"))
    return results.join(points, key, "left")


def write_results(results: DataFrame, path: str, network: RoadNetwork, epsg: int | None = None) -> None:
    """One JSON object per fix: the mean place as [lat, lon], the state ([distance, speed] or [x, vx, y, vy]), its projected
    place, and the points of the path up to it, or null. The zone is ``epsg``, or each row's own in a column epsg. Sources
    are kept together and in order."""
    rows = with_path_points(with_mean_location(results, F.lit(epsg) if epsg else F.col("epsg")), network)
    rows = rows.repartition("source_id").sortWithinPartitions("source_id", "record_number")
    state = F.when(F.col("on_road"), F.array("dist", "speed")).otherwise(F.array("x", "vx", "y", "vy"))
    points = F.transform("path_points", lambda p: F.array(p["x"], p["y"]))
    whole = F.struct(state.alias("state"), F.array("x", "y").alias("stateLoc"), points.alias("path"))
    rows.select("source_id", "record_number", F.array("lat", "lon").alias("meanLocation"), whole.alias("state")).write.json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What `write_results` wrote, for accuracy measures (`operators.learning`); source ids as text."""
    schema = "source_id string, record_number int, meanLocation array<double>, state struct<state: array<double>, stateLoc: array<double>, path: array<array<double>>>"
    place = lambda k: F.get("state.stateLoc", F.lit(k))
    return spark.read.schema(schema).json(path).withColumns({"x": place(0), "y": place(1), "on_road": F.size("state.state") == 2})


def track_file(spark: SparkSession, trace: str, network: RoadNetwork, params: TrackingParameters, out: str, method: str = "pl") -> DataFrame:
    """From a trace file to result objects: reads fixes, filters each source's, writes the results and reads them again.
    The network is projected into the zone of the fixes; sources have ids of any text."""
    write_results(filter_fixes(read_trace(spark, trace), network, params, method), out, network)
    return read_results(spark, out)


def heaviest(weighted: DataFrame, log_w: str = "log_w", n: int = 20) -> DataFrame:
    """The n heaviest states, for a look at a resampling distribution."""
    return weighted.orderBy(F.desc(log_w)).limit(n)
