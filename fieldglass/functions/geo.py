"""Distances on the globe, boxes in pictures, and shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The earth's radius, and how far a vehicle may get.
EARTH_KM = 6371.0
REACH_KMH, REACH_LEAST_KM, REACH_MOST_KM = 60.0, 3.0, 25.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if a coordinate is."""
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def reach_km(minutes: Column) -> Column:
    """How far a vehicle may be after so many minutes, within bounds."""
    return F.least(F.lit(REACH_MOST_KM), F.greatest(F.lit(REACH_LEAST_KM), minutes / 60 * REACH_KMH))


def overlap(a: list[Column], b: list[Column]) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side(0, 2) * side(1, 3)


def area(a: list[Column]) -> Column:
    return (a[2] - a[0]) * (a[3] - a[1])


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2); 0 for empty ones."""
    both = overlap(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def inside_share(a: list[Column], b: list[Column]) -> Column:
    """Intersection as a share of the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, overlap(a, b) / least).otherwise(F.lit(0.0))


def in_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon: an odd number of edges cross the ray to its right."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(corners, corners[1:] + corners[:1], strict=True):
        if y1 != y2:
            spans = (F.lit(y1) > y) != (F.lit(y2) > y)
            at = F.lit(float(x2 - x1)) * (y - y1) / F.lit(float(y2 - y1)) + F.lit(float(x1))
            crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1


def histogram_similarity(a: Column, b: Column) -> Column:
    """Bhattacharyya coefficient of two arrays, normalised to sums of 1."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, x: s + x)
    return both / F.sqrt(total(a) * total(b))
