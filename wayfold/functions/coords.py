"""Coordinate systems, tiles and local distances, as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spherical radius of web maps, the GRS80 ellipsoid, the central-belt grid.
SPHERE = 6_378_137.0
GRS80_A, GRS80_F = 6_378_137.0, 1 / 298.257222101
BELT = {"lat0": 38.0, "lon0": 127.0, "scale": 1.0, "east": 200_000.0, "north": 600_000.0}
TILE = 256


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres, which are not metres on the ground."""
    return F.radians(lon) * SPHERE, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * SPHERE


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SPHERE), F.degrees(F.atan(F.exp(y / SPHERE)) * 2 - math.pi / 2)


def _series() -> tuple[float, list[float], list[float]]:
    """Radius of the rectifying sphere and the coefficients of both series, in the third flattening."""
    n = GRS80_F / (2 - GRS80_F)
    radius = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = [
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
        13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140,
        49561 * n**4 / 161280,
    ]
    back = [
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    ]
    return radius, forward, back


_E = math.sqrt(GRS80_F * (2 - GRS80_F))


def _conformal(lat: float) -> float:
    s = math.sin(lat)
    return math.atanh(s) - _E * math.atanh(_E * s)


def _meridian(lat: float) -> float:
    radius, forward, _ = _series()
    xi = math.atan(math.sinh(_conformal(lat)))
    return radius * (xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(forward)))


def to_belt(lon: Column, lat: Column, grid: dict[str, float] = BELT) -> tuple[Column, Column]:
    """Transverse Mercator metres (east, north), by the series in the third flattening."""
    radius, forward, _ = _series()
    phi, lam = F.radians(lat), F.radians(lon - grid["lon0"])
    s = F.sin(phi)
    q = F.atanh(s) - F.atanh(s * _E) * _E
    xi0, eta0 = F.atan2(F.sinh(q), F.cos(lam)), F.atanh(F.sin(lam) / F.cosh(q))
    xi, eta = xi0, eta0
    for j, a in enumerate(forward):
        k = 2.0 * (j + 1)
        xi = xi + F.sin(xi0 * k) * F.cosh(eta0 * k) * a
        eta = eta + F.cos(xi0 * k) * F.sinh(eta0 * k) * a
    return eta * (grid["scale"] * radius) + grid["east"], xi * (grid["scale"] * radius) + (
        grid["north"] - grid["scale"] * _meridian(math.radians(grid["lat0"]))
    )


def from_belt(east: Column, north: Column, grid: dict[str, float] = BELT) -> tuple[Column, Column]:
    """(lon, lat) of transverse Mercator metres."""
    radius, _, back = _series()
    unit = grid["scale"] * radius
    xi0 = (north - (grid["north"] - grid["scale"] * _meridian(math.radians(grid["lat0"])))) / unit
    eta0 = (east - grid["east"]) / unit
    xi, eta = xi0, eta0
    for j, b in enumerate(back):
        k = 2.0 * (j + 1)
        xi = xi - F.sin(xi0 * k) * F.cosh(eta0 * k) * b
        eta = eta - F.cos(xi0 * k) * F.sinh(eta0 * k) * b
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    # fixed-point steps from the conformal to the geographic latitude
    phi = chi
    q = F.atanh(F.sin(chi))
    for _ in range(4):
        phi = F.asin(F.tanh(q + F.atanh(F.sin(phi) * _E) * _E))
    return F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + grid["lon0"], F.degrees(phi)


def pixel(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """World pixel coordinates at a zoom."""
    size = float(TILE * 2**zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2
    return (lon + 180) / 360 * size, y * size


def tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    x, y = pixel(lon, lat, zoom)
    return F.floor(x / TILE), F.floor(y / TILE)


def ground_resolution(lat: Column, zoom: int) -> Column:
    """Metres on the ground of a pixel."""
    return F.cos(F.radians(lat)) * (2 * math.pi * SPHERE / (TILE * 2**zoom))


def local_metres(lon: Column, lat: Column, lon0: float, lat0: float) -> tuple[Column, Column]:
    """East and north of a point near by."""
    degree = math.pi * SPHERE / 180
    return (lon - lon0) * (degree * math.cos(math.radians(lat0))), (lat - lat0) * degree


def valid(lon: Column, lat: Column, box: tuple[float, float, float, float] = (124.0, 33.0, 132.0, 39.0)) -> Column:
    """Whether coordinates lie in a box; a missing one does not."""
    return F.coalesce(lon.between(box[0], box[2]) & lat.between(box[1], box[3]), F.lit(False))


def zoom_verdict(gain: Column, deeper_gain: Column, rule: float = 1.2) -> Column:
    """The deepest native zoom: the last step counts only if both steps gain sharpness."""
    return F.when((gain >= rule) & (deeper_gain >= rule), 20).when(gain >= rule, 19).otherwise(18)


def pixel_gate(pixels: Column) -> Column:
    return F.when(pixels >= 10, "enough").when(pixels >= 6, "borderline").otherwise("too few")
