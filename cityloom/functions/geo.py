"""Planar geometry and the UTM projection as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid and the Krüger series to the fourth order.
_A, _INV_F = 6378137.0, 298.257223563
_N = 1.0 / (2.0 * _INV_F - 1.0)
_E2 = (2.0 - 1.0 / _INV_F) / _INV_F
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_K0, _EAST0 = 0.9996, 500000.0


def utm_sql(lng: str, lat: str, zone: int) -> tuple[str, str]:
    """Easting and northing of a northern UTM zone as SQL text, valid in Spark and in ANSI SQL."""
    e = math.sqrt(_E2)
    phi = f"radians({lat})"
    lam = f"radians(({lng}) - ({zone * 6 - 183}))"
    t = (
        f"sinh(atanh(sin({phi})) - {e!r} * atanh({e!r} * sin({phi})))"
    )
    xi = f"atan2({t}, cos({lam}))"
    eta = f"atanh(sin({lam}) / sqrt(1 + {t} * {t}))"
    sx = " + ".join([eta] + [f"{a!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)])
    sy = " + ".join([xi] + [f"{a!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, a in enumerate(_ALPHA, 1)])
    scale = _K0 * _RADIUS
    return f"({_EAST0!r} + {scale!r} * ({sx}))", f"({scale!r} * ({sy}))"


def project_utm(lng: Column, lat: Column, zone: int = 18) -> tuple[Column, Column]:
    """Easting and northing in metres on the northern grid of ``zone`` (18 or 17 here)."""
    e = math.sqrt(_E2)
    phi = F.radians(lat)
    lam = F.radians(lng - F.lit(float(zone * 6 - 183)))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(_EAST0) + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def project_point(lng: float, lat: float, zone: int = 18) -> tuple[float, float]:
    """The same projection for one literal point."""
    e = math.sqrt(_E2)
    phi, lam = math.radians(lat), math.radians(lng - (zone * 6 - 183))
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.sqrt(1 + t * t))
    x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _EAST0 + _K0 * _RADIUS * x, _K0 * _RADIUS * y


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def point_segment_distance(px, py, x1, y1, x2, y2) -> Column:
    """Distance from a point to a segment; a segment of length zero is its point."""
    dx, dy = x2 - x1, y2 - y1
    sq = dx * dx + dy * dy
    t = ((px - x1) * dx + (py - y1) * dy) / F.when(sq > 0, sq)
    t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), F.lit(0.0))
    ex, ey = px - (x1 + t * dx), py - (y1 + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def _side(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_segment_distance(a: Column, b: Column) -> Column:
    """Distance between two segments given as structs ``x1, y1, x2, y2``; 0 when they cross."""
    a1, a2, a3, a4 = a["x1"], a["y1"], a["x2"], a["y2"]
    b1, b2, b3, b4 = b["x1"], b["y1"], b["x2"], b["y2"]
    cross = (_side(a1, a2, a3, a4, b1, b2) * _side(a1, a2, a3, a4, b3, b4) < 0) & (
        _side(b1, b2, b3, b4, a1, a2) * _side(b1, b2, b3, b4, a3, a4) < 0
    )
    ends = F.least(
        point_segment_distance(a1, a2, b1, b2, b3, b4),
        point_segment_distance(a3, a4, b1, b2, b3, b4),
        point_segment_distance(b1, b2, a1, a2, a3, a4),
        point_segment_distance(b3, b4, a1, a2, a3, a4),
    )
    return F.when(cross, F.lit(0.0)).otherwise(ends)


def ray_crosses(px, py, e: Column) -> Column:
    """Does the ray from the point to the right cross edge ``x1, y1, x2, y2``?"""
    straddles = (e["y1"] > py) != (e["y2"] > py)
    at = e["x1"] + (py - e["y1"]) / F.when(straddles, e["y2"] - e["y1"]) * (e["x2"] - e["x1"])
    return straddles & (px < at)
