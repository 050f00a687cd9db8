"""Identifiers that depend only on content, so that re-deriving a row gives the same one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIP_DOMAIN = "trip-v1"
EVENT_DOMAIN = "event-v1"


def content_id(domain: str, *parts: Column | str) -> Column:
    """First 16 bytes of a SHA-256 over the parts, as 32 hex digits."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha2(F.concat_ws("|", F.lit(domain), *cols), 256), 1, 32)


def trip_id(content_root: Column | str = "content_root") -> Column:
    return content_id(TRIP_DOMAIN, content_root)


def event_id(content_root: Column | str, kind: Column | str, seq: Column | str) -> Column:
    return content_id(EVENT_DOMAIN, content_root, kind, seq)
