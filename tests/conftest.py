from __future__ import annotations

import datetime as dt

import pytest

from odolake.schemas import SAMPLE_TABLES
from odolake.session import local_session
from odolake.sources.tables import Tables


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, "4g")
    yield session


@pytest.fixture(scope="session")
def make(spark):
    """Sample tables from rows given as dictionaries; every other column is NULL."""

    def build(**rows) -> Tables:
        frames = {}
        for name, schema in SAMPLE_TABLES.items():
            given = [tuple(r.get(f.name) for f in schema) for r in rows.get(name, [])]
            frames[name] = spark.createDataFrame(given, schema)
        return Tables(frames)

    return build


def at(ms: float, base: str = "2026-01-01T00:00:00") -> dt.datetime:
    return dt.datetime.fromisoformat(base) + dt.timedelta(milliseconds=ms)


def row(vehicle="v", boot="A", ms=0, seq=None, when=None, **more) -> dict:
    return {
        "vehicle_id": vehicle, "boot_id": boot, "mono_ms": ms, "seq": ms if seq is None else seq,
        "observed_at": when, "content_root": more.pop("root", None), **more,
    }


def collect(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]
