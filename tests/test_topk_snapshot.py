"""First rows of a key without ranking it as a whole; snapshots by vehicle ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odolake.operators.topk import first_rows
from odolake.plans import wifi
from odolake.sources import sinks
from odolake.sources.tables import Tables
from tests.conftest import at, collect, row


def brute(rows, k):
    want = []
    for key in {r[0] for r in rows}:
        want += sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))[:k]
    return sorted(want, key=repr)


@pytest.mark.parametrize("k", [1, 5, 16])
def test_first_rows_of_a_hot_key(spark, k):
    # A key with nearly all rows, one of a single row, one that is NULL; values tie in long runs.
    rows = [("hot", i * 7919 % 50, i) for i in range(6000)] + [("one", 3, 1)] + [(None, i % 3, i) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, v int, id int")
    got = first_rows(df, ["key"], [F.desc("v"), F.asc("id")], k, slice_rows=64)
    assert sorted(collect(got, "key", "v", "id"), key=repr) == brute(rows, k)


def test_first_rows_of_equal_rows_empty_tables_and_no_limit(spark):
    df = spark.createDataFrame([("a", 1)] * 500 + [("b", 2)], "key string, v int")
    assert sorted(collect(first_rows(df, ["key"], [F.desc("v")], 3, slice_rows=16), "key", "v")) == [("a", 1)] * 3 + [("b", 2)]
    assert first_rows(df.where("false"), ["key"], [F.desc("v")], 3).count() == 0
    assert first_rows(df, ["key"], [F.desc("v")], 0).count() == 0


def test_a_device_carries_its_best_anchors(spark):
    learned = spark.range(3000).select(
        F.lit("v").alias("vehicle_id"), F.format_string("02:00:00:00:%02x:%02x", (F.col("id") / 256).cast("int"), (F.col("id") % 256).cast("int")).alias("bssid"),
        F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), (F.col("id") % 100).alias("observations"), F.lit(10.0).alias("spread_m"),
        F.lit(-50).alias("max_rssi_dbm"), F.lit(None).cast("timestamp_ntz").alias("last_seen"),
    )
    fitted = spark.createDataFrame([("d", "V")], "device_id string, vehicle_id string")
    got = collect(wifi.wifi_anchors(learned, fitted, limit=40), "observations", "bssid")
    assert sorted(o for o, _ in got) == [98] * 10 + [99] * 30
    assert sorted(b for o, b in got if o == 98) == [f"02:00:00:00:{i // 256:02x}:{i % 256:02x}" for i in range(98, 1098, 100)]


def test_snapshot_by_vehicle_ranges(spark, make, tmp_path):
    polls = [row(vehicle=f"v{i % 40}" if i % 41 else None, ms=i, when=at(i), root="r", speed_kph=i % 90) for i in range(400)]
    tables = make(obd=polls)
    empty = tables.gap.select("vehicle_id", "boot_id", "started_at")
    root = str(tmp_path)
    frames = Tables({**{n: tables[n] for n in sinks.SNAPSHOT_TABLES}, "v_drive_summary": tables.obd.select("vehicle_id", "boot_id"), "v_trip_summary": empty})
    counts = sinks.export_snapshot(frames, root)
    expected = {}
    for p in polls:
        expected[p["vehicle_id"]] = expected.get(p["vehicle_id"], 0) + 1
    assert dict(collect(counts.where("table = 'obd'"), "vehicle_id", "rows")) == expected
    # Files follow the bytes: far fewer than vehicles.
    files = {r.file for r in spark.read.parquet(f"{root}/manifest").where("table = 'obd'").collect()}
    assert len(files) < 40
    for wanted in (["v3"], ["v3", "v17"], [None], ["v5", None], ["nobody"], []):
        got = sorted(r[0] for r in collect(sinks.snapshot_slice(spark, root, "obd", wanted), "mono_ms"))
        assert got == sorted(p["mono_ms"] for p in polls if p["vehicle_id"] in wanted)
    opened = sinks.snapshot_slice(spark, root, "obd", ["v3"]).inputFiles()
    named = spark.read.parquet(f"{root}/manifest").where("table = 'obd' AND vehicle_id = 'v3'").count()
    assert len(opened) == named
    assert sinks.snapshot_slice(spark, root, "gap", ["v3"]).count() == 0
