"""Distances, grids and projection as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along the sphere."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(1.0) - h, F.lit(0.0))))


def cell(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(float(size))).cast("long")


def point_segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The squared distance of a point from a straight segment."""
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(len2, F.lit(0.0)))))
    ex, ey = px - (ax + t * dx), py - (ay + t * dy)
    return ex * ex + ey * ey


def segment_distance2(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """The squared distance of two straight segments, 0 where they cross or touch."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    apart = lambda u, v: ((u > 0) & (v < 0)) | ((u < 0) & (v > 0))
    crossing = apart(side(ax, ay, bx, by, cx, cy), side(ax, ay, bx, by, dx, dy)) & apart(side(cx, cy, dx, dy, ax, ay), side(cx, cy, dx, dy, bx, by))
    ends = [(ax, ay, cx, cy, dx, dy), (bx, by, cx, cy, dx, dy), (cx, cy, ax, ay, bx, by), (dx, dy, ax, ay, bx, by)]
    return F.when(crossing, 0.0).otherwise(F.least(*(point_segment_distance2(*e) for e in ends)))


def polyline_distance2(px: Column, py: Column, line: Column) -> Column:
    """The squared distance of a point from a polyline: array<struct<x,y>>."""
    steps = F.sequence(F.lit(1), F.greatest(F.size(line) - 1, F.lit(1)))
    one = lambda i: point_segment_distance2(px, py, F.element_at(line, i)["x"], F.element_at(line, i)["y"], F.element_at(line, F.least(i + 1, F.size(line)))["x"], F.element_at(line, F.least(i + 1, F.size(line)))["y"])
    return F.array_min(F.transform(steps, one))


def in_polygon(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is inside a ring (array<struct<x,y>>), by crossing count."""
    n = F.size(ring)

    def crosses(acc: Column, i: Column) -> Column:
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == n, 1).otherwise(i + 1))
        spans = (a["y"] > py) != (b["y"] > py)
        at = F.try_divide((b["x"] - a["x"]) * (py - a["y"]), b["y"] - a["y"]) + a["x"]
        return acc + F.when(spans & (px < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), crosses) % 2 == 1


# The GRS80 ellipsoid and the Korean unified grid (EPSG:5179).
_A, _F = 6378137.0, 1 / 298.257222101
_LAT0, _LON0, _K0, _X0, _Y0 = math.radians(38.0), math.radians(127.5), 0.9996, 1_000_000.0, 2_000_000.0


def _arc(lat):
    """Meridian arc from the equator; works on numbers and columns alike."""
    e2 = _F * (2 - _F)
    sin = math.sin if isinstance(lat, float) else F.sin
    c0 = 1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256
    c2 = 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024
    c4 = 15 * e2**2 / 256 + 45 * e2**3 / 1024
    c6 = 35 * e2**3 / 3072
    return (lat * c0 - sin(lat * 2) * c2 + sin(lat * 4) * c4 - sin(lat * 6) * c6) * _A


def to_grid(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(x, y) in metres of the unified grid: transverse Mercator, series to the sixth order."""
    e2 = _F * (2 - _F)
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon) - _LON0
    n = F.lit(_A) / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t = F.pow(F.tan(phi), 2)
    c = ep2 * F.pow(F.cos(phi), 2)
    a = lam * F.cos(phi)
    x = _K0 * n * (a + (1 - t + c) * F.pow(a, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(a, 5) / 120) + _X0
    m = _arc(phi) - _arc(_LAT0)
    y = _K0 * (m + n * F.tan(phi) * (a * a / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(a, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(a, 6) / 720)) + _Y0
    return x, y
