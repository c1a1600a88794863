"""Geometry as column expressions. Degrees in, metres out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres per degree in the planar frame; not the same sphere as EARTH_M, on purpose.
DEGREE_M = 111_320.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def weld_key(value: Column, weld_m: float = 1.0) -> Column:
    """The cell of weld_m metres of latitude that a coordinate falls into."""
    return F.rint(value / (weld_m / DEGREE_M)).cast("long")


def coordinate_key(value: Column) -> Column:
    """A coordinate at 7 decimals, as an integer."""
    return F.rint(value * 1e7).cast("long")


def closure_limit_m(length_m: Column, tolerance_m: float) -> Column:
    """How far apart the ends of a line of this length may be and still count as closed."""
    return F.least(F.lit(tolerance_m), 0.05 * length_m)


def to_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> tuple[Column, Column]:
    """Distance from a point to a segment and the fraction of the nearest place on it, in a plane about the point."""
    kx, ky = DEGREE_M * F.cos(F.radians(lat)), DEGREE_M
    dx, dy = lon2 * kx - lon1 * kx, lat2 * ky - lat1 * ky
    ex, ey = lon * kx - lon1 * kx, lat * ky - lat1 * ky
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / square)))
    return F.sqrt((ex - t * dx) ** 2 + (ey - t * dy) ** 2), t


def box(lats: tuple[Column, Column], lons: tuple[Column, Column], radius_m: Column | float) -> tuple[Column, Column, Column, Column]:
    """Least and greatest latitude and longitude of all that lies within radius_m of the given ranges."""
    worst = F.greatest(F.abs(lats[0]), F.abs(lats[1]))
    dlat = F.lit(radius_m) / DEGREE_M if not isinstance(radius_m, Column) else radius_m / DEGREE_M
    dlon = dlat / F.greatest(F.lit(0.05), F.cos(F.radians(worst)))
    return lats[0] - dlat, lats[1] + dlat, lons[0] - dlon, lons[1] + dlon
