"""Distances on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371000.0
METRES_PER_DEGREE = 111320.0


def great_circle_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """SQL text of the great-circle distance in metres between two points given as column names or numbers."""
    half_lat, half_lon = f"sin(radians(({lat2}) - ({lat1})) / 2)", f"sin(radians(({lon2}) - ({lon1})) / 2)"
    h = f"pow({half_lat}, 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow({half_lon}, 2)"
    # Not least(): it would skip a NULL coordinate and give half the earth's circumference.
    return f"(2 * {EARTH_RADIUS_M}D * asin(sqrt(CASE WHEN ({h}) > 1.0D THEN 1.0D ELSE ({h}) END)))"


def great_circle_m(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    return F.expr(great_circle_sql(lat1, lon1, lat2, lon2))


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """The same distance inside Python row logic."""
    half_lat, half_lon = math.radians(lat2 - lat1) / 2, math.radians(lon2 - lon1) / 2
    h = math.sin(half_lat) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS_M * math.asin(math.sqrt(min(h, 1.0)))
