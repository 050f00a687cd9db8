"""Files in, files out, profiles and findings."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from odolake.plans import insight, ledger
from odolake.sources import dimensions, profiles, records, sinks
from odolake.sources.tables import scan
from tests.conftest import at, collect, row


def test_audit_reads_only_the_last_days(spark, tmp_path):
    for day in range(1, 6):
        entry = {"ts": f"2026-03-0{day}T10:00:00Z", "actor_type": "client", "route": "GET /v1/pull" if day % 2 else "GET /v1/health", "status": 200, "actor_id": f"a{day}"}
        (tmp_path / f"2026-03-0{day}.jsonl").write_text(json.dumps(entry) + "\n")
    rows = records.read_audit(spark, str(tmp_path), 3, dt.date(2026, 3, 5))
    assert rows.count() == 3
    assert collect(ledger.recent_activity(rows, "2026-03-01", 10), "client_id") == [("a5",), ("a3",)]
    assert records.read_audit(spark, str(tmp_path), 3, dt.date(2027, 1, 1)).count() == 0


def test_ledger_reports_every_bad_line(spark, tmp_path):
    lines = [json.dumps({"utc_ms": 1, "event": "offered", "content_root": "r", "path": "lte"}), "{torn", json.dumps({"utc_ms": 5, "event": "committed", "content_root": "r", "bytes": 9}), "not json"]
    (tmp_path / "2026-03-01.jsonl").write_text("\n".join(lines) + "\n")
    rows = records.read_ledger(spark, str(tmp_path))
    assert sorted(r[0] for r in collect(records.bad_lines(rows), "line")) == ["not json", "{torn"]
    got = collect(ledger.arrival_metadata(records.entries(rows)), "content_root", "path", "size_bytes", "duration_ms")
    assert got == [("r", "lte", 9, 4)]


def test_registry_tunes(spark, tmp_path):
    doc = {"vehicles": [{"id": "AB", "engine_code": " n20 ", "tunes": [{"id": "t", "at": "2026-08-01", "note": "Stage 2"}]}, {"id": "cd", "archived_at": "2026-01-01"}]}
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=1))
    registry = dimensions.read_registry(spark, str(tmp_path / "v.json"))
    assert collect(dimensions.tune_rows(registry), "vehicle_id", "tune_id", "tuned_at") == [("ab", "t", dt.datetime(2026, 8, 1))]
    limits = profiles.limits_for(registry, profiles.limit_rows(spark, profiles.catalogue()))
    got = {r[0]: r[1] for r in collect(limits.where("metric = 'boost_psi'"), "vehicle_id", "has_signal")}
    assert got == {"ab": True, "cd": False}


@pytest.mark.parametrize(
    "change",
    [{"id": "Bad Id"}, {"status": "guess"}, {"signals": [{"key": "a", "min": 2, "max": 1}]}, {"status": "stub"}, {"codes": ["n20"]}, {"extra": 1}],
)
def test_profiles_that_do_not_check_are_refused(change):
    good = {"id": "x", "name": "X", "status": "derived", "codes": ["X1"], "signals": [{"key": "lambda", "min": 0, "max": 2, "warn_high": 1.2}], "thresholds": {}}
    assert len(profiles.catalogue([good])) == 3
    with pytest.raises(ValueError, match="profile|code"):
        profiles.catalogue([{**good, **change}])


def findings(spark, code, **stat):
    base = {"vehicle_id": "v", "metric": "ltft_pct", "recent_median": 0.0, "recent_n": 5, "baseline_median": None, "baseline_n": 0, "tuned_at": None}
    s = {**base, **stat}
    schema = "vehicle_id string, metric string, recent_median double, recent_n bigint, baseline_median double, baseline_n bigint, tuned_at timestamp_ntz"
    stats = spark.createDataFrame([tuple(s.values())], schema)
    vehicles = spark.createDataFrame([("v", code)], "vehicle_id string, engine_code string")
    limits = profiles.limits_for(vehicles, profiles.limit_rows(spark, profiles.catalogue()))
    return collect(insight.health_findings(stats, limits), "status", "sentence")


@pytest.mark.parametrize(
    ("code", "stat", "status", "words"),
    [
        ("N20", {"recent_median": 2.0}, "ok", "+2%, inside the normal range"),
        ("N20", {"recent_median": 12.0}, "watch", "+12%: the engine is adding fuel"),
        ("N20", {"recent_median": -21.0}, "check", "taking fuel away"),
        ("N20", {"recent_median": 30.0}, "check", "outside what the sensor can report"),
        ("N20", {"recent_median": 2.5}, "ok", "is +2%,"),
        ("N20", {"metric": "boost_psi", "recent_median": 21.3}, "watch", "around 21.3 psi; this engine normally stays under 20.0 psi. Worth keeping an eye on."),
        ("N20", {"metric": "lambda", "recent_median": 0.9}, "ok", "is 0.90, which is normal"),
        ("N20", {"recent_median": 8.0, "baseline_median": 1.0, "baseline_n": 3}, "check", "moved from +1% to +8%"),
        ("N20", {"recent_median": 1.0, "baseline_median": 5.0, "baseline_n": 3}, "watch", "taking away more fuel"),
        ("B58", {"metric": "stft_pct", "recent_median": 1.0, "baseline_median": 0.0, "baseline_n": 4}, "ok", "steady at +1%, the same as before"),
    ],
)
def test_findings(spark, code, stat, status, words):
    got = findings(spark, code, **stat)
    assert len(got) == 1 and got[0][0] == status and words in got[0][1], got


@pytest.mark.parametrize(
    ("code", "stat"),
    [("N20", {"recent_n": 2}), ("B58", {"recent_median": 12.0}), ("", {"metric": "boost_psi", "recent_median": 50.0}), ("N20", {"recent_median": None})],
)
def test_nothing_known_gives_no_row(spark, code, stat):
    assert findings(spark, code, **stat) == []


def test_store_round_trip_and_replace(spark, make, tmp_path):
    t = make(obd=[row(ms=i, when=at(i), root=f"r{i % 3}", rpm=i) for i in range(90)])
    sinks.write_store(t, str(tmp_path / "store"))
    assert scan(spark, str(tmp_path / "store")).obd.count() == 90
    path = str(tmp_path / "months")
    moved = t.obd.withColumn("observed_at", F.expr("observed_at - INTERVAL '40' DAY"))
    sinks.write_months(moved, path, "observed_at", "overwrite")
    for _ in range(2):
        sinks.replace_bundles(spark, path, t.obd.where("content_root = 'r1'"), "observed_at")
    got = dict(collect(spark.read.parquet(path).groupBy("month").count(), "month", "count"))
    assert got == {"2025-11": 60, "2026-01": 30}


def test_filters_and_columns_reach_the_scan(spark, make, tmp_path):
    sinks.write_store(make(obd=[row(ms=i, rpm=i) for i in range(10)]), str(tmp_path))
    df = scan(spark, str(tmp_path)).obd.where("boot_id = 'A' AND mono_ms BETWEEN 2 AND 5").select("rpm")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(mono_ms,2)" in plan and "EqualTo(boot_id,A)" in plan
    assert "coolant_c" not in plan.split("ReadSchema")[1]
