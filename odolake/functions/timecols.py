"""Clock arithmetic on zone-less UTC timestamps (sessions run in UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def millis(col: Column | str) -> Column:
    """Epoch milliseconds of a zone-less UTC timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unix_millis(c.cast("timestamp"))


def from_millis(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_millis(c.cast("long")).cast("timestamp_ntz")
