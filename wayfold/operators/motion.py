"""Motion with constant velocity and acceleration noise: prediction, measurement, likelihoods.

An axis has the state (place, speed), the transition [[1, t], [0, 1]], the noise factor (t^2/2, t). With isotropic
covariances the two ground axes are alike and independent, so the ground filter is one axis filter used twice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import gaussian


def noise(t: float, q: float) -> tuple[float, float, float]:
    """Covariance of the noise of one step: c00, c01, c11."""
    a, b = t * t / 2, t
    return q * a * a, q * a * b, q * b * b


def initial_covariance(r: float, t: float) -> tuple[float, float, float]:
    """Of a place measured with variance r, and a speed from two such places."""
    return r, r / t, 2 * r / (t * t)


def predicted_covariance(c: tuple, t: float, q: float) -> tuple:
    """A C A' + noise, from (c00, c01, c11) as floats, arrays or columns."""
    n00, n01, n11 = noise(t, q)
    return c[0] + 2 * t * c[1] + t * t * c[2] + n00, c[1] + t * c[2] + n01, c[2] + n11


def predict(rows: DataFrame, t: float, c: tuple[float, float, float], q: float) -> DataFrame:
    """Adds the prediction of ground states (x, vx, y, vy): px, pvx, py, pvy and the axis covariance p00, p01, p11."""
    p00, p01, p11 = predicted_covariance(c, t, q)
    return rows.withColumns({"px": F.col("x") + t * F.col("vx"), "pvx": F.col("vx"), "py": F.col("y") + t * F.col("vy"), "pvy": F.col("vy"), "p00": F.lit(p00), "p01": F.lit(p01), "p11": F.lit(p11)})


def observation_log_likelihood(x: Column, y: Column, px: Column, py: Column, variance: Column) -> Column:
    """Of a fix under a predicted place with the same variance (prediction plus measurement) on both axes."""
    zero = F.lit(0.0)
    return gaussian.normal2_log(x - px, y - py, variance, zero, variance)


def axis_filter(z: np.ndarray, t: float, r: float, q: float, before: tuple | None = None) -> np.ndarray:
    """Filtered (place, speed, c00, c01, c11) after each measurement, going on from the row ``before``; without one the
    first measurement starts the filter with speed 0."""
    out = np.empty((len(z), 5))
    for k, x in enumerate(z.tolist()):
        if before is None:
            before = (x, 0.0, *initial_covariance(r, t))
        else:
            m0, m1, *c = before
            m0 = m0 + t * m1
            p00, p01, p11 = predicted_covariance(tuple(c), t, q)
            s = p00 + r
            k0, k1, e = p00 / s, p01 / s, x - m0
            before = (m0 + k0 * e, m1 + k1 * e, p00 - k0 * p00, p01 - k0 * p01, p11 - k1 * p01)
        out[k] = before
    return out


def kalman_offroad(fixes: DataFrame, t: float, r: float, q: float) -> DataFrame:
    """The ground filter over each source's fixes in the order of record_number: source_id, record_number, x, vx, y, vy
    and the axis covariance c00, c01, c11. A task takes a source's fixes in Arrow batches and carries the state along."""

    def run(batches):
        last, fx, fy = None, None, None
        for rows in batches:
            if not len(rows):
                continue
            sources = rows["source_id"].to_numpy()
            cuts = np.flatnonzero(np.append(True, sources[1:] != sources[:-1]))
            parts = []
            for a, b in zip(cuts, np.append(cuts[1:], len(sources)), strict=True):
                ends = (None, None) if last is None or sources[a] != last else (tuple(fx[-1]), tuple(fy[-1]))
                fx, fy = (axis_filter(rows[c].to_numpy(dtype=float)[a:b], t, r, q, end) for c, end in zip(("x", "y"), ends, strict=True))
                parts.append(np.concatenate([fx[:, :2], fy], axis=1))
                last = sources[a]
            found = pd.DataFrame(np.concatenate(parts), columns=["x", "vx", "y", "vy", "c00", "c01", "c11"])
            yield pd.concat([rows[["source_id", "record_number"]].reset_index(drop=True), found], axis=1)

    kind = dict(fixes.dtypes)["source_id"]
    dealt = fixes.select("source_id", "record_number", "x", "y").repartition("source_id").sortWithinPartitions("source_id", "record_number")
    return dealt.mapInPandas(run, f"source_id {kind}, record_number int, x double, vx double, y double, vy double, c00 double, c01 double, c11 double")


def edge_predictive(d: Column, v: Column, c00: Column, c01: Column, c11: Column, start: Column, length: Column, t: float) -> tuple[Column, Column, Column, Column, Column]:
    """The road state given that it lies on an edge, taken as a normal law of the edge's middle and the standard
    deviation length / sqrt(12): mean d, v and covariance. The speed does not fall below 0."""
    spread = length * length / 12
    s = c00 + spread
    w0, w1 = c00 / s, c01 / s
    e = start + length / 2 - d
    return d + w0 * e, F.greatest(F.lit(0.0), v + w0 * e / t), c00 - w0 * w0 * s, c01 - w0 * w1 * s, c11 - w1 * w1 * s
