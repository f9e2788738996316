"""Simulated vehicles with known truth: motion and measurements drawn from the model itself."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.operators.filters import OFF, Cloud, Tracker, initial_values
from wayfold.operators.network import CompactNetwork, RoadNetwork
from wayfold.params import TrackingParameters

SIMULATED = "source_id long, record_number int, t_ms long, x double, y double, true_on_road boolean, true_edge_id int, true_dist double, true_speed double, true_x double, true_vx double, true_y double, true_vy double"


def simulate_trace(net: CompactNetwork, params: TrackingParameters, source: int, steps: int, start: tuple[float, float] | None = None, speed: float = 0.0) -> list[tuple]:
    """One vehicle: true state and measured place of each step. It starts at ``start``, or at the network's centre,
    on the closest segment if the road is possible, and moves along it at ``speed``."""
    tracker = Tracker(net, params, "bootstrap", source)
    rng = np.random.default_rng([params.seed & 0x7FFFFFFF, source & 0x7FFFFFFF])
    lo, hi = np.minimum(net.p0, net.p1).min(axis=0), np.maximum(net.p0, net.p1).max(axis=0)
    at = np.array(start) if start is not None else (lo + hi) / 2
    believed = initial_values(params)
    p = Cloud(np.array([OFF]), np.array([[at[0], 0.0, at[1], 0.0]]), np.zeros((1, 3)), *(believed[k][None, :] for k in ("obs", "road", "ground", "on", "off")), [()])
    if believed["on"][2] > 0 and believed["off"][2] < 1:
        every = np.arange(len(net.seg_len))
        d, far = net.project(np.broadcast_to(at, (len(every), 2)), every)
        ties = np.flatnonzero(far <= far.min() + 1e-9)
        s = int(ties[int(rng.integers(len(ties)))])
        p.seg, p.mean = np.array([s]), np.array([[net.start[s] + d[s], speed, 0.0, 0.0]])
    out, ms = [], round(params.freq) * 1000
    for k in range(steps):
        if k:
            p = tracker.propagate(p, rng)
        g, s = tracker.grounded(p)[0], int(p.seg[0])
        z = g[[0, 2]] + math.sqrt(params.obs_cov[0]) * rng.standard_normal(2)
        road = (True, int(net.edge_id[net.seg_edge[s]]), float(p.mean[0, 0]), float(p.mean[0, 1])) if s != OFF else (False, None, None, None)
        out.append((source, k, k * ms, float(z[0]), float(z[1]), *road, *map(float, g)))
    return out


def simulate(spark: SparkSession, network: RoadNetwork, params: TrackingParameters, vehicles: int, steps: int, start: tuple[float, float] | None = None, speed: float = 0.0) -> DataFrame:
    """Fixes and truth of vehicles 0 to ``vehicles`` - 1, vehicle k at first ``speed`` times k fast. Vehicles are
    independent, so there is no shuffle."""
    sent = spark.sparkContext.broadcast(network.compact())  # at most BROADCAST_SEGMENTS segments
    names = [c.split()[0] for c in SIMULATED.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [r for v in batch["source_id"].tolist() for r in simulate_trace(sent.value, params, int(v), steps, start, speed * int(v))]
            yield pd.DataFrame(rows, columns=names).astype({"true_edge_id": "Int32", "true_dist": "Float64", "true_speed": "Float64"})

    return spark.range(vehicles).select(F.col("id").alias("source_id")).mapInPandas(run, SIMULATED)
