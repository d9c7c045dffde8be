"""Coordinate reference systems as expressions: geographic WGS 84, Web Mercator and the UTM zones of WGS 84, by EPSG code.

Transverse Mercator is the series in the third flattening to its fourth power, good to a tenth of a millimetre within a zone.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the WGS-84 ellipsoid, the scale on a zone's central meridian, and false eastings and northings
MAJOR, FLATTENING, SCALE, EAST, NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_RECTIFIED = MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ECC = math.sqrt(FLATTENING * (2 - FLATTENING))
# fixed values: the coefficients of the series, forward and back, as polynomials of the third flattening from its first power on
_FORWARD = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (0, 13 / 48, -3 / 5, 557 / 1440), (0, 0, 61 / 240, -103 / 140), (0, 0, 0, 49561 / 161280))
_BACK = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (0, 1 / 48, 1 / 15, -437 / 1440), (0, 0, 17 / 480, -37 / 840), (0, 0, 0, 4397 / 161280))


#: The codes that parsed() knows.
CODES = r"(?i)^\s*EPSG:(4326|3857|32[67](0[1-9]|[1-5][0-9]|60))\s*$"


def _series(table: tuple) -> list[float]:
    return [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in table]


def parsed(code: str | None) -> tuple[str, int] | None:
    """("geographic", 0), ("mercator", 0) or ("utm", zone), negative south of the equator; None for other systems."""
    found = re.fullmatch(r"\s*EPSG:([0-9]+)\s*", code or "", re.IGNORECASE)
    number = int(found[1]) if found else 0
    if number in (4326, 3857):
        return ("geographic" if number == 4326 else "mercator"), 0
    for base, sign in ((32600, 1), (32700, -1)):
        if 1 <= number - base <= 60:
            return "utm", sign * (number - base)
    return None


def _meridian(zone: int) -> float:
    return math.radians(6 * abs(zone) - 183)


def to_geographic(x: Column, y: Column, code: str) -> tuple[Column, Column]:
    """Longitude and latitude in degrees. ValueError for a system that isn't known."""
    kind = parsed(code)
    if kind is None:
        raise ValueError(f"unknown coordinate reference system {code}")
    if kind[0] == "geographic":
        return x, y
    if kind[0] == "mercator":
        return F.degrees(x / MAJOR), F.degrees(F.atan(F.sinh(y / MAJOR)))
    north = F.lit(NORTH if kind[1] < 0 else 0.0)
    xi, eta = (y - north) / (SCALE * _RECTIFIED), (x - EAST) / (SCALE * _RECTIFIED)
    a, b = xi, eta
    for j, c in enumerate(_series(_BACK), 1):
        a = a - F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    # the latitude follows from the conformal one by fixed-point steps
    conformal = F.sin(a) / F.cosh(b)
    isometric = F.atanh(conformal)
    lat = F.asin(conformal)
    for _ in range(5):
        lat = F.asin(F.tanh(isometric + F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(lat))))
    return F.degrees(F.lit(_meridian(kind[1])) + F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


def from_geographic(lon: Column, lat: Column, code: str) -> tuple[Column, Column]:
    """Coordinates of longitude and latitude in degrees. ValueError for a system that isn't known."""
    kind = parsed(code)
    if kind is None:
        raise ValueError(f"unknown coordinate reference system {code}")
    if kind[0] == "geographic":
        return lon, lat
    phi = F.radians(lat)
    if kind[0] == "mercator":
        return F.lit(MAJOR) * F.radians(lon), F.lit(MAJOR) * F.asinh(F.tan(phi))
    away = F.radians(lon) - F.lit(_meridian(kind[1]))
    isometric = F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi))
    t = F.sinh(isometric)
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    a, b = xi, eta
    for j, c in enumerate(_series(_FORWARD), 1):
        a = a + F.lit(c) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b + F.lit(c) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return F.lit(EAST) + F.lit(SCALE * _RECTIFIED) * b, F.lit(NORTH if kind[1] < 0 else 0.0) + F.lit(SCALE * _RECTIFIED) * a


def moved(x: Column, y: Column, source: Column, codes: list[str], target: str) -> tuple[Column, Column]:
    """x and y of the system that source names (one of codes) in another one; NULL for others. Equal systems keep their numbers."""
    pairs = [(source == code, (x, y) if code == target else from_geographic(*to_geographic(x, y, code), target)) for code in codes]
    pick = lambda k: F.coalesce(*(F.when(on, xy[k]) for on, xy in pairs)) if pairs else F.lit(None).cast("double")
    return pick(0), pick(1)


def moved_back(x: Column, y: Column, source: str, target: Column, codes: list[str]) -> tuple[Column, Column]:
    """x and y of one system in the system that target names (one of codes); NULL for others."""
    pairs = [(target == code, (x, y) if code == source else from_geographic(*to_geographic(x, y, source), code)) for code in codes]
    pick = lambda k: F.coalesce(*(F.when(on, xy[k]) for on, xy in pairs)) if pairs else F.lit(None).cast("double")
    return pick(0), pick(1)
