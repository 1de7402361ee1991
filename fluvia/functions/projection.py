"""Map projections as Column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Half axis in metres and flattening of the ellipsoids WGS 84 and Bessel 1841; radius of the web map sphere.
WGS84 = (6378137.0, 1 / 298.257223563)
BESSEL = (6377397.155, 1 / 299.1528128)
RADIUS = 6378137.0


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres from degrees; latitudes of 90 degrees have none."""
    return F.radians(lon) * RADIUS, F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * RADIUS


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / RADIUS), F.degrees(2 * F.atan(F.exp(y / RADIUS)) - math.pi / 2)


def to_transverse_mercator(lon: Column, lat: Column, middle: float, scale: float = 0.9996, east: float = 500000.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Metres from degrees around a central meridian, by Krueger's series to the third power of the third flattening."""
    a, f = ellipsoid
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    s, d = F.sin(F.radians(lat)), F.radians(lon - middle)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return east + scale * radius * x, north + scale * radius * y


def from_transverse_mercator(x: Column, y: Column, middle: float, scale: float = 0.9996, east: float = 500000.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Degrees from metres around a central meridian, by the series that turn back those of to_transverse_mercator."""
    a, f = ellipsoid
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (y - north) / (scale * radius), (x - east) / (scale * radius)
    u, v = xi, eta
    for j, k in enumerate(beta, 1):
        u = u - k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        v = v - k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = chi
    for j, k in enumerate(delta, 1):
        lat = lat + k * F.sin(2 * j * chi)
    return middle + F.degrees(F.atan2(F.sinh(v), F.cos(u))), F.degrees(lat)


def to_cartesian(lon: Column, lat: Column, height: Column, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    """Earth-centred metres from degrees and a height above the ellipsoid."""
    a, f = ellipsoid
    e2, phi, lam = f * (2 - f), F.radians(lat), F.radians(lon)
    across = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    return (across + height) * F.cos(phi) * F.cos(lam), (across + height) * F.cos(phi) * F.sin(lam), (across * (1 - e2) + height) * F.sin(phi)


def from_cartesian(x: Column, y: Column, z: Column, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column, Column]:
    """Degrees and height from earth-centred metres, by two steps over the reduced latitude."""
    a, f = ellipsoid
    e2, b = f * (2 - f), a * (1 - f)
    flat = F.sqrt(x * x + y * y)
    reduced = F.atan2(z * a, flat * b)
    for _ in range(2):
        phi = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(reduced), F.lit(3)), flat - e2 * a * F.pow(F.cos(reduced), F.lit(3)))
        reduced = F.atan2((1 - f) * F.sin(phi), F.cos(phi))
    across = a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi))
    height = flat * F.cos(phi) + z * F.sin(phi) - a * a / across
    return F.degrees(F.atan2(y, x)), F.degrees(phi), height


def shift_datum(lon: Column, lat: Column, old: tuple[float, float], new: tuple[float, float], seven: tuple[float, ...], height: Column | float = 0.0, back: bool = False) -> tuple[Column, Column, Column]:
    """Degrees and height on another datum, through earth-centred coordinates.

    seven: metres along x, y and z, turns about them in seconds of arc (of the position vector), and a
    change of scale in millionths, from the old datum to the new. back: from new to old, by the inverse matrix.
    """
    tx, ty, tz, *turns, ppm = seven
    rx, ry, rz = (math.radians(t / 3600) for t in turns)
    s = 1 + ppm * 1e-6
    m = np.array([[s, -s * rz, s * ry], [s * rz, s, -s * rx], [-s * ry, s * rx, s]])
    t = np.array([tx, ty, tz])
    if back:
        old, new, m = new, old, np.linalg.inv(m)
        t = -m @ t
    p = to_cartesian(lon, lat, height if isinstance(height, Column) else F.lit(float(height)), old)
    moved = (sum((float(m[i, j]) * p[j] for j in range(1, 3)), float(m[i, 0]) * p[0]) + float(t[i]) for i in range(3))
    return from_cartesian(*moved, new)


def transform_rings(rings: Column, move) -> Column:
    """Rings (arrays of arrays of x and y) with move(x, y) -> (x, y) applied to every point."""

    def point(p: Column) -> Column:
        x, y = move(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(rings, lambda ring: F.transform(ring, point))
