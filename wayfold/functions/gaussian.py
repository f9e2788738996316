"""Densities and log-space arithmetic as column expressions; special functions as vectorised UDFs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

LOG_2PI = math.log(2 * math.pi)

# Coefficients of a Chebyshev series of the complementary error function, and of a rational approximation
# of the normal quantile (middle and tail).
_ERFC = (
    -1.3026537197817094, 6.4196979235649026e-1, 1.9476473204185836e-2, -9.561514786808631e-3, -9.46595344482036e-4, 3.66839497852761e-4, 4.2523324806907e-5,
    -2.0278578112534e-5, -1.624290004647e-6, 1.303655835580e-6, 1.5626441722e-8, -8.5238095915e-8, 6.529054439e-9, 5.059343495e-9, -9.91364156e-10,
    -2.27365122e-10, 9.6467911e-11, 2.394038e-12, -6.886027e-12, 8.94487e-13, 3.13092e-13, -1.12708e-13, 3.81e-16, 7.106e-15, -1.523e-15, -9.4e-17, 1.21e-16, -2.8e-17,
)
_MIDDLE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))


def erfc(x: np.ndarray) -> np.ndarray:
    """The complementary error function, to double precision."""
    x = np.asarray(x, dtype=float)
    z = np.minimum(np.abs(x), 40.0)
    t = 2 / (2 + z)
    y = 4 * t - 2
    d, dd = np.zeros_like(z), np.zeros_like(z)
    for c in _ERFC[:0:-1]:
        d, dd = y * d - dd + c, d
    out = t * np.exp(-z * z + 0.5 * (_ERFC[0] + y * d) - dd)
    return np.where(x >= 0, out, 2 - out)


def quantile(p: np.ndarray) -> np.ndarray:
    """The inverse of the standard normal distribution function: a rational approximation and two steps of Halley's."""
    p = np.clip(np.asarray(p, dtype=float), 1e-300, 1 - 1e-16)
    q, low = p - 0.5, np.minimum(p, 1 - p)
    r = q * q
    middle = np.polyval(_MIDDLE[0], r) * q / np.polyval(_MIDDLE[1], r)
    s = np.sqrt(-2 * np.log(low))
    x = np.where(low < 0.02425, np.sign(-q) * np.polyval(_TAIL[0], s) / np.polyval(_TAIL[1], s), middle)
    for _ in range(2):
        # the error, from the nearer tail
        e = np.where(q < 0, phi(x) - p, (1 - p) - phi(-x)) * math.sqrt(2 * math.pi) * np.exp(np.minimum(x * x / 2, 700.0))
        x = x - e / (1 + x * e / 2)
    return x


def normal_log(x: Column, mean: Column, variance: Column) -> Column:
    return -0.5 * (F.lit(LOG_2PI) + F.log(variance) + (x - mean) * (x - mean) / variance)


def normal2_log(dx: Column, dy: Column, a: Column, b: Column, c: Column) -> Column:
    """Log density of a deviation (dx, dy) under the covariance [[a, b], [b, c]]."""
    det = a * c - b * b
    return -F.lit(LOG_2PI) - 0.5 * F.log(det) - 0.5 * (c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det


def phi(z: np.ndarray) -> np.ndarray:
    """Standard normal distribution function."""
    return 0.5 * erfc(-np.asarray(z, dtype=float) / math.sqrt(2))


def truncated_mean(mean: np.ndarray, sd: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mean of a normal truncated to [low, high]; where almost no mass lies inside, the nearer bound."""
    return truncated_moments(mean, sd, low, high)[0]


@F.pandas_udf(DoubleType())
def truncated_normal_mean(mean: pd.Series, sd: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series(truncated_mean(*(s.to_numpy(dtype=float) for s in (mean, sd, low, high))))


@F.pandas_udf(DoubleType())
def folded_normal_mean(mean: pd.Series, sd: pd.Series) -> pd.Series:
    """Mean of |X|, the distance law on [0, inf)."""
    m, s = mean.to_numpy(dtype=float), sd.to_numpy(dtype=float)
    return pd.Series(s * math.sqrt(2 / math.pi) * np.exp(-(m**2) / (2 * s**2)) + m * (1 - erfc(m / (s * math.sqrt(2)))))


def dirichlet_mean(a: Column, b: Column) -> Column:
    """Mean of the first outcome; an infinite parameter makes its outcome certain."""
    infinite = F.lit(float("inf"))
    return F.when(a == infinite, F.lit(1.0)).when(b == infinite, F.lit(0.0)).otherwise(a / (a + b))


def truncated_moments(mean: np.ndarray, sd: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and variance of a normal truncated to [low, high]; where almost no mass lies inside, the nearer bound and 0."""
    mean, sd, low, high = (np.asarray(v, dtype=float) for v in (mean, sd, low, high))
    a, b = (low - mean) / sd, (high - mean) / sd
    mass = np.where(a > 0, phi(-a) - phi(-b), phi(b) - phi(a))
    finite = lambda z: np.where(np.isfinite(z), z, 0.0)
    density = lambda z: np.where(np.isfinite(z), np.exp(-0.5 * finite(z) ** 2), 0) / math.sqrt(2 * math.pi)
    with np.errstate(divide="ignore", invalid="ignore"):
        shift = (density(a) - density(b)) / mass
        spread = 1 + (finite(a) * density(a) - finite(b) * density(b)) / mass - shift**2
    some = mass > 1e-300
    middle = np.where(some, np.clip(mean + sd * shift, low, high), np.where(a > 0, low, high))
    return middle, np.where(some, sd**2 * np.clip(spread, 0, 1), 0.0)


@F.pandas_udf(StructType([StructField("mean", DoubleType()), StructField("variance", DoubleType())]))
def truncated_law(mean: pd.Series, variance: pd.Series, low: pd.Series, high: pd.Series) -> pd.DataFrame:
    """Mean and variance of a truncated normal."""
    m, v = truncated_moments(mean.to_numpy(dtype=float), np.sqrt(variance.to_numpy(dtype=float)), low.to_numpy(dtype=float), high.to_numpy(dtype=float))
    return pd.DataFrame({"mean": m, "variance": v})


def truncated_log_density(d: Column, mean: Column, variance: Column, low: Column, high: Column) -> Column:
    """Log density of a distance on [low, high]: minus infinity outside, else that of the normal with the mean and the
    variance of the truncated law."""
    law = truncated_law(mean, variance, low, high)
    return F.when((d < low) | (d > high), F.lit(float("-inf"))).otherwise(normal_log(d, law["mean"], law["variance"]))


@F.pandas_udf(DoubleType())
def dirichlet_log_density(p: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """Log density of the probability of the first of two outcomes."""
    log_beta = np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    x = p.to_numpy(dtype=float)
    return pd.Series((a.to_numpy() - 1) * np.log(x) + (b.to_numpy() - 1) * np.log1p(-x) - log_beta)


@F.pandas_udf(DoubleType())
def truncated_quantile(u: pd.Series, mean: pd.Series, sd: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    """The value below which a share ``u`` of a truncated normal lies."""
    return pd.Series(draw_truncated(*(x.to_numpy(dtype=float) for x in (u, mean, sd, low, high))))


def speed_given_distance(d: Column, mean_d: Column, mean_v: Column, c00: Column, c01: Column) -> Column:
    """Mean speed of a road state whose distance is known; at least 0."""
    return F.greatest(F.lit(0.0), mean_v + c01 / c00 * (d - mean_d))


def draw_truncated(u: np.ndarray, mean: np.ndarray, sd: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The inverse distribution function of a truncated normal at ``u``; without any spread, the mean pulled inside."""
    mean, low, high = (np.asarray(v, dtype=float) for v in (mean, low, high))
    wide = np.maximum(sd, 1e-300)
    a, b = (low - mean) / wide, (high - mean) / wide
    flip = a > 0  # both bounds in the upper tail: from the other side
    lo, hi = phi(np.where(flip, -b, a)), phi(np.where(flip, -a, b))
    z = quantile(lo + np.where(flip, 1 - u, u) * (hi - lo))
    x = mean + sd * np.where(flip, -z, z)
    return np.clip(np.where(hi > lo, x, np.where(flip, low, np.where(b < 0, high, mean))), low, high)
