"""Map projections between EPSG:4326, EPSG:3857 and the UTM zones (EPSG:326zz and 327zz).

Each formula is written once over a set of functions, so the same text serves Catalyst columns,
NumPy arrays and SQL text. Axes are x/y (longitude first) throughout.
"""

from __future__ import annotations

import math
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from .boxes import WGS84_A, WGS84_F

NAMES = ("sin", "cos", "tan", "sinh", "cosh", "asin", "atan", "atanh", "sqrt", "exp", "radians", "degrees")
COLUMN = SimpleNamespace(**{n: getattr(F, n) for n in NAMES}, log=F.log)
NUMPY = SimpleNamespace(
    **{n: getattr(np, {"asin": "arcsin", "atan": "arctan", "atanh": "arctanh"}.get(n, n)) for n in NAMES}, log=np.log
)


class Sql:
    """SQL text that grows under arithmetic."""

    def __init__(self, text: str) -> None:
        self.text = text

    def _with(self, op: str, other: object, swapped: bool = False) -> Sql:
        o = other.text if isinstance(other, Sql) else f"({other!r}::DOUBLE)"
        return Sql(f"({o} {op} {self.text})" if swapped else f"({self.text} {op} {o})")

    __add__ = lambda s, o: s._with("+", o)
    __radd__ = lambda s, o: s._with("+", o, True)
    __sub__ = lambda s, o: s._with("-", o)
    __rsub__ = lambda s, o: s._with("-", o, True)
    __mul__ = lambda s, o: s._with("*", o)
    __rmul__ = lambda s, o: s._with("*", o, True)
    __truediv__ = lambda s, o: s._with("/", o)


SQL = SimpleNamespace(**{n: (lambda x, n=n: Sql(f"{n}({x.text})")) for n in NAMES}, log=lambda x: Sql(f"ln({x.text})"))

_N = WGS84_F / (2 - WGS84_F)
_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_K0 = 0.9996
_C = 2 * math.sqrt(_N) / (1 + _N)
#: Coefficients of the transverse Mercator series in the third flattening, to its fourth power.
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_INVERSE = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def to_mercator(m, lon, lat):
    return m.radians(lon) * WGS84_A, m.log(m.tan(m.radians(lat) * 0.5 + math.pi / 4)) * WGS84_A


def from_mercator(m, x, y):
    return m.degrees(x / WGS84_A), m.degrees(m.atan(m.exp(y / WGS84_A)) * 2.0 - math.pi / 2)


def to_utm(m, lon, lat, zone: int, south: bool = False):
    """Easting and northing in a UTM zone."""
    s = m.sin(m.radians(lat))
    t = m.sinh(m.atanh(s) - _C * m.atanh(_C * s))
    d = m.radians(lon - (6.0 * zone - 183.0))
    xi, eta = m.atan(t / m.cos(d)), m.atanh(m.sin(d) / m.sqrt(t * t + 1.0))
    e, n = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        e = e + c * (m.cos(xi * (2.0 * j)) * m.sinh(eta * (2.0 * j)))
        n = n + c * (m.sin(xi * (2.0 * j)) * m.cosh(eta * (2.0 * j)))
    return e * (_K0 * _RADIUS) + 500_000.0, n * (_K0 * _RADIUS) + (10_000_000.0 if south else 0.0)


def from_utm(m, x, y, zone: int, south: bool = False):
    """Longitude and latitude of a point of a UTM zone."""
    xi, eta = (y - (10_000_000.0 if south else 0.0)) / (_K0 * _RADIUS), (x - 500_000.0) / (_K0 * _RADIUS)
    a, b = xi, eta
    for j, c in enumerate(_INVERSE, 1):
        a = a - c * (m.sin(xi * (2.0 * j)) * m.cosh(eta * (2.0 * j)))
        b = b - c * (m.cos(xi * (2.0 * j)) * m.sinh(eta * (2.0 * j)))
    chi = m.asin(m.sin(a) / m.cosh(b))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * m.sin(chi * (2.0 * j))
    return m.degrees(m.atan(m.sinh(b) / m.cos(a))) + (6.0 * zone - 183.0), m.degrees(lat)


def _zone(srid: int) -> tuple[int, bool] | None:
    for base, south in ((32600, False), (32700, True)):
        if 1 <= srid - base <= 60:
            return srid - base, south
    return None


def reproject(m, x, y, source: int, target: int):
    """A point from one reference system to another; unknown systems raise ValueError."""
    if source == target:
        return x, y
    if source == 3857:
        x, y = from_mercator(m, x, y)
    elif _zone(source):
        x, y = from_utm(m, x, y, *_zone(source))
    elif source != 4326:
        raise ValueError(f"unsupported reference system EPSG:{source}")
    if target == 3857:
        return to_mercator(m, x, y)
    if _zone(target):
        return to_utm(m, x, y, *_zone(target))
    if target != 4326:
        raise ValueError(f"unsupported reference system EPSG:{target}")
    return x, y


def reproject_polygons(polygons: list, source: int, target: int) -> list:
    """Vertices of (multi)polygons reprojected; edges stay straight."""
    out = []
    for p in polygons:
        rings = []
        for r in p:
            a = np.asarray(r, np.float64)
            x, y = reproject(NUMPY, a[:, 0], a[:, 1], source, target)
            rings.append(list(zip(np.asarray(x).tolist(), np.asarray(y).tolist())))
        out.append(rings)
    return out
