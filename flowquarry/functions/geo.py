"""Great-circle and polygon expressions, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km; null if a coordinate is null."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def point_in_polygon(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd test against ``ring``, an array of struct(lat, lon) whose last point joins the first.

    Lower and left edges count as inside, upper and right ones as outside. Rings of under three points hold nothing.
    """
    n = F.size(ring)
    steps = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def crosses(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        alat, alon, blat, blon = a["lat"], a["lon"], b["lat"], b["lon"]
        spans = (alat > lat) != (blat > lat)
        at = alon + (lat - alat) / F.when(spans, blat - alat) * (blon - alon)
        return F.when(spans & (lon < at), 1).otherwise(0)

    odd = F.aggregate(steps, F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1
    return F.coalesce((n >= 3) & odd, F.lit(False))
