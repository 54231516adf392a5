"""Closed-form algebra of axis-parallel boxes as Catalyst expressions.

A box is four columns minx, miny, maxx, maxy, optionally below a prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("minx", "miny", "maxx", "maxy")
#: WGS84, fixed values.
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563
_B = WGS84_A * (1 - WGS84_F)
_E = math.sqrt(WGS84_F * (2 - WGS84_F))


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in SIDES)


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def overlaps(a, b) -> Column:
    """Closed intersection: boxes that touch overlap."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def intersection(a, b) -> tuple[Column, Column, Column, Column]:
    return F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])


def intersection_area(a, b) -> Column:
    i = intersection(a, b)
    return F.greatest(i[2] - i[0], F.lit(0)) * F.greatest(i[3] - i[1], F.lit(0))


def iou(a, b) -> Column:
    """Planar intersection over union; 0 for boxes without a common area.

    Kept small: it is evaluated inside join conditions, whose generated code must stay compilable.
    """
    both = intersection_area(a, b)
    return F.when(both > 0, both.cast("double") / (area(a) + area(b) - both).cast("double")).otherwise(F.lit(0.0))


def center(b) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def aspect(b) -> Column:
    """Longer over shorter side; null for a box without width or height."""
    w, h = b[2] - b[0], b[3] - b[1]
    return F.when((w > 0) & (h > 0), F.greatest(w, h).cast("double") / F.least(w, h).cast("double"))


def wkt(b) -> Column:
    """The ring of a box, counter-clockwise from its lower right corner."""
    at = lambda x, y: F.concat_ws(" ", x.cast("string"), y.cast("string"))
    ring = F.concat_ws(", ", at(b[2], b[1]), at(b[2], b[3]), at(b[0], b[3]), at(b[0], b[1]), at(b[2], b[1]))
    return F.concat(F.lit("POLYGON (("), ring, F.lit("))"))


def to_degrees(b, lon0: float = 10.0, lat0: float = 49.0, unit: float = 0.0001):
    """Grid units to degrees."""
    return F.lit(lon0) + b[0] * F.lit(unit), F.lit(lat0) + b[1] * F.lit(unit), F.lit(lon0) + b[2] * F.lit(unit), F.lit(lat0) + b[3] * F.lit(unit)


def _zone(lat: Column) -> Column:
    """Area integral up to a parallel, per unit of longitude."""
    s = F.sin(F.radians(lat))
    return s / (F.lit(1.0) - F.lit(_E * _E) * s * s) + F.log((F.lit(1.0) + F.lit(_E) * s) / (F.lit(1.0) - F.lit(_E) * s)) / F.lit(2 * _E)


def ellipsoid_area(b) -> Column:
    """Area in square metres of a lon/lat quadrangle on WGS84 (its upper and lower edges are parallels)."""
    return F.abs(F.lit(_B * _B / 2) * F.radians(b[2] - b[0]) * (_zone(b[3]) - _zone(b[1])))


def ellipsoid_area_sql(minx: str, miny: str, maxx: str, maxy: str) -> str:
    """The same in SQL."""
    s = lambda y: f"sin(radians({y}))"
    z = lambda y: f"({s(y)} / (1.0 - {_E * _E!r}::DOUBLE * {s(y)} * {s(y)}) + ln((1.0 + {_E!r}::DOUBLE * {s(y)}) / (1.0 - {_E!r}::DOUBLE * {s(y)})) / {2 * _E!r}::DOUBLE)"
    return f"abs({_B * _B / 2!r}::DOUBLE * radians({maxx} - {minx}) * ({z(maxy)} - {z(miny)}))"
