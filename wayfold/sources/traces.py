"""Traces and configurations: CSV scans, JSON configurations, observation JSON."""

from __future__ import annotations

import json
import math
from dataclasses import replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators.observations import linked
from wayfold.params import TrackingParameters

#: The trace file has a header and at least eight columns; these places (from 0) count.
PLACES = {"source_id": 3, "lat": 4, "lon": 5, "ts": 6, "velocity": 7}
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
OBSERVATION = "source_id string, ts timestamp, lat double, lon double, velocity double, heading double, fix_quality double"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Fixes of a ``;``-separated file: source_id, ts, lat, lon, velocity, heading and fix_quality (null), projected
    x and y with their epsg, record_number. A file with only a header gives no rows."""
    names = [f"c{k}" for k in range(max(PLACES.values()) + 1)]
    raw = spark.read.option("sep", ";").option("header", True).option("mode", "PERMISSIVE").schema(", ".join(f"{n} string" for n in names)).csv(path)
    at = {name: F.col(names[k]) for name, k in PLACES.items()}
    fixes = raw.select(at["source_id"].alias("source_id"), F.to_timestamp(at["ts"], TIME_FORMAT).alias("ts"), *(at[c].cast("double").alias(c) for c in ("lat", "lon", "velocity")))
    empty = F.lit(None).cast("double")
    return linked(projected(fixes.withColumns({"heading": empty, "fix_quality": empty})))


def projected(fixes: DataFrame) -> DataFrame:
    """Adds x, y (each fix in its own UTM zone) and epsg."""
    x, y = geo.to_utm(F.col("lat"), F.col("lon"))
    return fixes.withColumns({"x": x, "y": y, "epsg": geo.epsg(F.col("lat"), F.col("lon"))})


def write_trace(fixes: DataFrame, path: str) -> None:
    """The same file format, one folder of part files, sources kept together and in order."""
    columns = [F.lit("").alias(f"unused_{k}") for k in range(3)]
    rows = fixes.repartition("source_id").sortWithinPartitions("source_id", "ts")
    rows.select(*columns, "source_id", "lat", "lon", F.date_format("ts", TIME_FORMAT).alias("ts"), "velocity").write.option("sep", ";").option("header", True).csv(path)


def observations_from_json(rows: DataFrame, column: str) -> DataFrame:
    """Observation objects in JSON text as columns; text that is no such object gives nulls."""
    return rows.withColumn("_o", F.from_json(column, OBSERVATION)).select(*rows.columns, "_o.*")


def numbers_from_json(text: Column) -> Column:
    """An array of numbers; null for other JSON; NaN is an error."""
    found = F.from_json(text, "array<double>", {"allowNonNumericNumbers": "true"})
    return F.when(F.exists(found, lambda v: F.isnan(v)), F.raise_error(F.lit("NaN in an array of numbers")).cast("array<double>")).otherwise(found)


_KEYS = {
    "obsCov": "obs_cov",
    "onRoadStateCov": "on_road_cov",
    "offRoadStateCov": "off_road_cov",
    "offTransitionProbs": "off_probs",
    "onTransitionProbs": "on_probs",
    "seed": "seed",
    "numParticles": "particles",
    "initialObsFreq": "freq",
    "obsCovDof": "obs_cov_dof",
    "onRoadCovDof": "on_road_cov_dof",
    "offRoadCovDof": "off_road_cov_dof",
    "obsCovarianceThreshold": "obs_cov_threshold",
    "stateCovarianceThreshold": "state_cov_threshold",
    "pathDistanceSearchUpperBound": "path_search_bound",
    "initialMotionState": "initial_motion",
}


def read_config(path: str) -> tuple[dict, TrackingParameters]:
    """The run's settings (trace and output file, network place) and its parameters. ``Infinity`` with either sign is
    a number here; a NaN or an unknown parameter is an error. Missing parameters keep their defaults."""

    def constant(name: str) -> float:
        if name == "NaN":
            raise ValueError("NaN in the configuration")
        return float(name)

    raw = json.loads(Path(path).read_text().replace("+Infinity", "Infinity"), parse_constant=constant)
    given = {}
    for key, value in raw.pop("initialParameters", {}).items():
        if key not in _KEYS:
            raise ValueError(f"unknown parameter {key!r}")
        own = _KEYS[key]
        as_number = int if own in ("seed", "particles") else float
        given[own] = tuple(float(v) for v in value) if isinstance(value, list) else as_number(value)
    params = replace(TrackingParameters(), **given)
    for name in ("obs_cov", "off_road_cov"):
        if len(set(getattr(params, name))) > 1:
            raise ValueError(f"{name}: variances that differ by axis are not supported")
    if any(math.isnan(v) for v in (*params.obs_cov, *params.on_probs, *params.off_probs)):
        raise ValueError("NaN in the configuration")
    return raw, params
