"""Distances, decay, scores, grid cells and projections."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Origin:
    """A place, and the radius of the earth that its distances assume."""

    lat: float
    lon: float
    radius_km: float = 6371.0


#: Bern, in the three forms in use; fixed values.
BERN_EXPORT = Origin(46.9480, 7.4474, 6371.0088)
BERN_SCORE = Origin(46.946461621956566, 7.4442526092578625, 6371.0)
BERN_VIEW = Origin(46.9480, 7.4474, 6371.0)


def haversine_km(lat: Column, lon: Column, origin: Origin, clamp: bool = True) -> Column:
    """Great-circle distance to the origin; null where a coordinate is."""
    d_lat = F.radians(lat - origin.lat) / 2
    d_lon = F.radians(lon - origin.lon) / 2
    h = F.sin(d_lat) * F.sin(d_lat) + F.lit(math.cos(math.radians(origin.lat))) * F.cos(
        F.radians(lat)
    ) * F.sin(d_lon) * F.sin(d_lon)
    root = F.least(F.lit(1.0), F.sqrt(h)) if clamp else F.sqrt(h)
    return F.when(lat.isNotNull() & lon.isNotNull(), 2 * origin.radius_km * F.asin(root))


def decay(distance: Column, radius_km: float) -> Column:
    """exp(-distance / radius); 0 for a radius that is not positive."""
    return F.exp(-distance / radius_km) if radius_km > 0 else F.lit(0.0)


def proximity(distance: Column, radius_km: float) -> Column:
    """Decay, and 1 for a case without coordinates."""
    return F.when(distance.isNull(), 1.0).otherwise(decay(distance, radius_km))


def same_context(lat: Column, lon: Column, radius: Column, origin: Origin, radius_km: float) -> Column:
    """Whether a stored relevance was computed for this place and radius."""
    near = lambda a, b: F.abs(a - F.lit(b)) < 1e-4
    return near(lat, origin.lat) & near(lon, origin.lon) & near(radius, radius_km)


def relevance(stored: Column, context_matches: Column, distance: Column, radius_km: float) -> Column:
    """The stored relevance where its context matches, else the proximity."""
    return F.when(context_matches & stored.isNotNull(), stored).otherwise(
        proximity(distance, radius_km)
    )


def grid_cell(c: Column, size: float = 0.1) -> Column:
    return F.round(c / size).cast("int")


def density(neighbours: Column, full: int = 150) -> Column:
    return F.least(F.lit(1.0), neighbours / full)


def severity(cases: Column, full: int = 500) -> Column:
    return F.least(F.lit(1.0), F.log10(cases + 1) / F.lit(math.log10(full)))


def score(near: Column, dense: Column, severe: Column, weight: float = 0.15) -> Column:
    return F.least(F.lit(1.0), near * (1 + weight * dense + weight * severe))


def priority(value: Column) -> Column:
    """1 (high) to 3 (low) by thresholds."""
    return F.when(value >= 0.8, 1).when(value >= 0.5, 2).otherwise(3)


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Web-Mercator metres."""
    x = lon * F.lit(20037508.342789244 / 180)
    y = F.ln(F.tan(F.radians(lat) / 2 + F.lit(math.pi / 4))) * F.lit(6378137.0)
    return x, y


def interpolate(t: Column, t0: Column, v0: Column, t1: Column, v1: Column) -> Column:
    return F.when(t1 == t0, v0).otherwise(v0 + (v1 - v0) * (t - t0) / (t1 - t0))


def planar_km(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Distance on a plane, a degree of longitude shortened by the latitude."""
    return F.hypot((lat - lat0) * 111.0, (lon - lon0) * F.lit(111.0 * math.cos(math.radians(lat0))))


def gaussian_kernel(distance: Column, radius: float) -> Column:
    return F.exp(-(distance * distance) / (2 * radius * radius))


def ramp(t: Column, low: tuple[int, int, int], high: tuple[int, int, int]) -> Column:
    """Colour between two, as #rrggbb."""
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    part = lambda a, b: F.lpad(F.lower(F.hex(F.round(F.lit(float(a)) + clamped * (b - a)).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), *(part(a, b) for a, b in zip(low, high, strict=True)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is empty or zero."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)
