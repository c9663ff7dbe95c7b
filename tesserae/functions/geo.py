"""Coordinates: bounding boxes, zones, transverse Mercator, snapped grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84.
A, FLAT, K0, EAST0, NORTH0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
#: Steps of the inverse: 3 within a zone, 10 as far out as the series has one inverse.
NEWTON = 10
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def bbox(lat: Column, lon: Column, radius_km: Column) -> dict[str, Column]:
    dlat = radius_km / 110.574
    dlon = radius_km / (111.320 * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return {
        "south": F.greatest(F.lit(-90.0), lat - dlat),
        "north": F.least(F.lit(90.0), lat + dlat),
        "west": F.greatest(F.lit(-180.0), lon - dlon),
        "east": F.least(F.lit(180.0), lon + dlon),
    }


def utm_zone(lon: Column) -> Column:
    return F.least(F.lit(60), F.greatest(F.lit(1), F.floor((lon + 180) / 6).cast("int") + 1))


def utm_epsg(lat: Column, lon: Column) -> Column:
    return F.when(lat >= 0, 32600).otherwise(32700) + utm_zone(lon)


def _on_sphere(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """The transverse Mercator projection of the conformal latitude, from which Krueger's series starts."""
    e = 2 * math.sqrt(_N) / (1 + _N)
    phi, dl = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    return F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))


def to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series in the third flattening."""
    xi, eta = _on_sphere(lat, lon, zone)
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EAST0 + K0 * _RADIUS * x, F.when(lat < 0, NORTH0).otherwise(0.0) + K0 * _RADIUS * y


def _step(s: Column, _: Column) -> Column:
    """A complex Newton step to the point (a, b) that the forward series takes to (xi, eta)."""
    a, b = s["a"], s["b"]
    f, g, p, q = a - s["xi"], b - s["eta"], F.lit(1.0), F.lit(0.0)
    for j, k in enumerate(_ALPHA, 1):
        sin, cos, sinh, cosh = F.sin(2 * j * a), F.cos(2 * j * a), F.sinh(2 * j * b), F.cosh(2 * j * b)
        f, g = f + k * sin * cosh, g + k * cos * sinh
        p, q = p + 2 * j * k * cos * cosh, q - 2 * j * k * sin * sinh
    size = p * p + q * q
    moved = F.struct((a - (f * p + g * q) / size).alias("a"), (b - (g * p - f * q) / size).alias("b"), s["xi"].alias("xi"), s["eta"].alias("eta"))
    return F.when(F.abs(b) == float("inf"), s).otherwise(moved)  # the pole is endlessly far, and no step leaves it


def one_to_one(lat: Column, lon: Column, zone: Column) -> Column:
    """Whether the series has one inverse here: its derivative has a positive real part as far from the meridian, and nearer to it."""
    eta = _on_sphere(lat, lon, zone)[1]
    return sum((2 * j * a * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1)), F.lit(0.0)) < 1


def from_utm(x: Column, y: Column, zone: Column, south: Column, at: tuple[Column, Column] | None = None) -> tuple[Column, Column]:
    """Latitude and longitude.

    By the pole of the projection the series takes several places to one point, which no point
    can tell apart.  `at`, a latitude and longitude, says which is meant: that which Newton's
    steps reach from there.  It is used only where the series isn't one_to_one().
    """
    xi = (y - F.when(south, NORTH0).otherwise(0.0)) / (K0 * _RADIUS)
    eta = (x - EAST0) / (K0 * _RADIUS)
    a, b = xi, eta
    for j, k in enumerate(_BETA, 1):
        a = a - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    if at is not None:
        sure, (near_a, near_b) = one_to_one(*at, zone), _on_sphere(*at, zone)
        a, b = F.when(sure, a).otherwise(near_a), F.when(sure, b).otherwise(near_b)
    # far outside a zone the inverse series fails, so its result only begins Newton's steps on to_utm()'s own
    last = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON)), F.struct(a.alias("a"), b.alias("b"), xi.alias("xi"), eta.alias("eta")), _step)
    a, b = last["a"], last["b"]
    chi = F.asin(F.sin(a) / F.cosh(b))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.degrees(phi), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(b), F.cos(a)))


def same_turn(lon: Column, at: Column) -> Column:
    """The same meridian in the turn of `at`: whole turns are lost in a projection, and are all that is added."""
    return lon + 360 * F.rint((at - lon) / 360)


def snapped(x: Column, step: float) -> Column:
    """Nearest multiple, halves to even."""
    return F.rint(x / step) * step
