"""Geographic projection as column expressions.

Universal Transverse Mercator on WGS84 by Krueger's series in the third flattening, to its third power (well under a
millimetre within a zone). Latitude and longitude are in degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and UTM.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500000.0, 10000000.0

N = FLATTENING / (2 - FLATTENING)
RECTIFYING = SEMI_MAJOR / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = 2 * math.sqrt(N) / (1 + N)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
INVERSE = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
LATITUDE = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def utm_zone(lon: Column) -> Column:
    """Zone 1 to 60; longitude 180 counts to zone 60; beyond [-180, 180] an error."""
    zone = F.when(lon == 180, F.lit(60)).otherwise(F.floor((lon + 180) / 6).cast("int") + 1)
    return F.when((lon < -180) | (lon > 180), F.raise_error(F.lit("longitude out of range")).cast("int")).otherwise(zone)


def epsg(lat: Column, lon: Column) -> Column:
    """EPSG code of the WGS84 UTM zone; the southern hemisphere adds 100."""
    return F.lit(32600) + utm_zone(lon) + F.when(lat < 0, F.lit(100)).otherwise(F.lit(0))


def _central(zone: Column) -> Column:
    return F.radians(zone * 6 - 183)


def _series(terms, f, g, a: Column, b: Column) -> Column:
    total = F.lit(0.0)
    for j, c in enumerate(terms, 1):
        total = total + F.lit(c) * f(2 * j * a) * g(2 * j * b)
    return total


def to_utm(lat: Column, lon: Column, zone: Column | None = None) -> tuple[Column, Column]:
    """(easting, northing) in ``zone`` (the point's own if none is given)."""
    zone = utm_zone(lon) if zone is None else zone
    phi, d = F.radians(lat), F.radians(lon) - _central(zone)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = FALSE_EASTING + SCALE * RECTIFYING * (eta + _series(FORWARD, F.cos, F.sinh, xi, eta))
    north = SCALE * RECTIFYING * (xi + _series(FORWARD, F.sin, F.cosh, xi, eta))
    return east, north + F.when(lat < 0, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))


def from_utm(east: Column, north: Column, code: Column) -> tuple[Column, Column]:
    """(lat, lon) of UTM coordinates with an EPSG code."""
    zone = code % 100
    xi = (north - F.when(code >= 32700, F.lit(FALSE_NORTHING_SOUTH)).otherwise(F.lit(0.0))) / (SCALE * RECTIFYING)
    eta = (east - FALSE_EASTING) / (SCALE * RECTIFYING)
    x = xi - _series(INVERSE, F.sin, F.cosh, xi, eta)
    y = eta - _series(INVERSE, F.cos, F.sinh, xi, eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi
    for j, c in enumerate(LATITUDE, 1):
        phi = phi + F.lit(c) * F.sin(2 * j * chi)
    return F.degrees(phi), F.degrees(_central(zone) + F.atan2(F.sinh(y), F.cos(x)))


def project_points(points: Column, zone: Column) -> Column:
    """An array of struct(lat, lon) as one of struct(x, y); all points in one zone (crossing zones is not supported)."""

    def one(p: Column) -> Column:
        east, north = to_utm(p["lat"], p["lon"], zone)
        return F.struct(east.alias("x"), north.alias("y"))

    return F.transform(points, one)


def invert_points(points: Column, code: Column) -> Column:
    """The inverse of `project_points`."""

    def one(p: Column) -> Column:
        lat, lon = from_utm(p["x"], p["y"], code)
        return F.struct(lat.alias("lat"), lon.alias("lon"))

    return F.transform(points, one)


def metres_to_degrees(metres: Column) -> Column:
    """Angle that a length spans on the equator."""
    return metres / (math.pi / 180) / SEMI_MAJOR
