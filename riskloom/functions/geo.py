"""Great-circle distance as columns."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance in km; null when any coordinate is missing."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half_lat = F.sin((p2 - p1) / 2)
    half_lon = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    a = half_lat * half_lat + F.cos(p1) * F.cos(p2) * half_lon * half_lon
    bounded = F.when(a.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), a)))
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(bounded))
