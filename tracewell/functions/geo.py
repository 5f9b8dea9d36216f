"""Scalar expressions over coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres on a sphere."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def coordinate(c: Column) -> Column:
    """Degrees of decimal text or DDMMSS; sentinels (0, beyond 180) are null."""
    x = F.regexp_replace(F.trim(c), ",", ".").try_cast("double")
    a = F.abs(x)
    dms = F.floor(a / 10000) + F.floor(F.floor(a % 10000) / 100) / 60 + (a % 100) / 3600
    out = F.when(a > 9999, F.signum(x) * dms).otherwise(x)
    return F.when((F.abs(out) <= 180) & (out != 0), out)


def grid(c: Column, metres: float = 500.0) -> Column:
    """Cell number of a coordinate, cut towards zero."""
    return (c / F.lit(metres / 111_000.0)).cast("bigint")
