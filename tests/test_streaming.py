"""Streams of fixes: late ones, duplicates, windows, one state over several batches."""

import datetime as dt
import time

import numpy as np
import pytest

from wayfold.operators.filters import filter_trace
from wayfold.operators.network import RoadNetwork, grid_edges
from wayfold.params import TrackingParameters
from wayfold.streaming import tracking

SCHEMA = "source_id long, ts timestamp, x double, y double"
PARAMS = TrackingParameters(particles=5, obs_cov_threshold=40.0)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


@pytest.fixture
def folder(spark, tmp_path):
    """Two batches; the second holds a fix of source 1 that is too late."""
    batches = [[(1, at(0), 10.0, 1.0), (1, at(30), 40.0, 0.0), (2, at(0), 100.0, 50.0)], [(1, at(20), 500.0, 500.0), (1, at(60), 80.0, 2.0), (2, at(30), 100.0, 80.0), (2, at(30), 100.0, 80.0)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files are taken in the order of their times
    return tmp_path


def test_late_fixes_are_dropped_and_counted(spark, folder):
    net = RoadNetwork(grid_edges(spark))
    fixes = spark.read.schema(SCHEMA).parquet(str(folder / "in"))
    out = tracking.replay(fixes, str(folder / "in"), net, PARAMS, str(folder / "out"), str(folder / "state"))
    rows = sorted(out.collect(), key=lambda r: (r["source_id"], r["record_number"]))
    assert [(r["source_id"], r["record_number"], r["late"]) for r in rows] == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 1)]
    batch = filter_trace(net.compact(), PARAMS, "pl", 1, np.array([[10.0, 1.0], [40.0, 0.0], [80.0, 2.0]]), [0, 1, 2])
    assert [(r["x"], r["y"]) for r in rows[:3]] == [(b[6], b[8]) for b in batch]


@pytest.mark.parametrize(("make", "expected"), [(tracking.drop_late, 6), (lambda s: tracking.windowed(s, "40 seconds", delay="1 second"), None)])
def test_watermarks(spark, folder, make, expected):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    name = f"sink_{'late' if expected else 'windows'}"
    query = make(stream).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.table(name)
    if expected:
        assert rows.count() == expected
    else:
        got = {(r["source_id"], r["window"]["start"].second): (r["n"], r["mean_x"]) for r in rows.collect()}
        assert got[(2, 0)][0] >= 1 and all(n >= 1 for n, _ in got.values())


def test_bootstrap_by_groups_of_sources(spark, folder):
    """Sources in one group of state keep their own particles, numbers and late fixes over batches."""
    net = RoadNetwork(grid_edges(spark))
    fixes = spark.read.schema(SCHEMA).parquet(str(folder / "in"))
    for groups in (1, 256):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(tracking, "GROUPS", groups)
            out = tracking.replay(fixes, str(folder / "in"), net, PARAMS, str(folder / f"out{groups}"), str(folder / f"state{groups}"), "bootstrap")
        rows = sorted(out.collect(), key=lambda r: (r["source_id"], r["record_number"]))
        assert [(r["source_id"], r["record_number"], r["late"]) for r in rows] == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (2, 0, 0), (2, 1, 1)]
        batch = filter_trace(net.compact(), PARAMS, "bootstrap", 1, np.array([[10.0, 1.0], [40.0, 0.0], [80.0, 2.0]]), [0, 1, 2])
        assert [(r["x"], r["y"]) for r in rows[:3]] == [pytest.approx((b[6], b[8])) for b in batch]
