"""Distances on the sphere, as haversines (squared half-chord lengths), in radians."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088  # fixed value: mean radius


def _square(x: Column) -> Column:
    return x * x


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine of the angle between two points; grows with the distance."""
    return _square(F.sin((lat1 - lat2) / 2)) + F.cos(lat1) * F.cos(lat2) * _square(
        F.sin((lng1 - lng2) / 2)
    )


def box_haversine(a: str, b: str) -> Column:
    """A lower bound of ``haversine`` between any points of two boxes.

    ``a`` and ``b`` prefix the columns ``lat_min, lat_max, lng_min, lng_max``.  The bound
    is exact for two single points.
    """

    def c(prefix, name):
        return F.col(f"{prefix}{name}")

    zero = F.lit(0.0)
    lat_gap = F.greatest(c(b, "lat_min") - c(a, "lat_max"), c(a, "lat_min") - c(b, "lat_max"), zero)
    inner = F.greatest(c(b, "lng_min") - c(a, "lng_max"), c(a, "lng_min") - c(b, "lng_max"), zero)
    around = 2 * math.pi - (
        F.greatest(c(a, "lng_max"), c(b, "lng_max")) - F.least(c(a, "lng_min"), c(b, "lng_min"))
    )
    lng_gap = F.least(inner, F.greatest(around, zero))

    def smallest_cos(prefix):
        return F.least(F.cos(c(prefix, "lat_min")), F.cos(c(prefix, "lat_max")))

    return _square(F.sin(lat_gap / 2)) + smallest_cos(a) * smallest_cos(b) * _square(
        F.sin(lng_gap / 2)
    )
