"""Raw record fields to typed rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odolake.functions import rawrows
from odolake.plans import load
from odolake.schemas import SAMPLE_TABLES
from tests.conftest import at, collect

BASE = 1767225600000  # 2026-01-01


@pytest.fixture(scope="module")
def basis(spark):
    return spark.createDataFrame([("r", BASE)], "content_root string, utc_basis_ms long")


def raw(spark, *rows):
    """Raw rows of one bundle; all fields are integers."""
    keys = {"vehicle_id": "v", "content_root": "r", "boot_id": "A", "mono_ms": 1000, "seq": 1}
    full = [{**keys, **r} for r in rows]
    names = list(dict.fromkeys(c for r in full for c in r))
    kinds = ", ".join(f"{c} {'string' if c in ('vehicle_id', 'content_root', 'boot_id') else 'long'}" for c in names)
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in full], kinds)


STATUS = ("battery_mv", "sd_write_errors", "sd_free_mib", "device_temp_c", "rssi_dbm", "ext_sensor1", "ext_sensor2")


def test_health_without_readings_is_null_and_zero_is_a_reading(spark, basis):
    silent = dict(zip(STATUS, (65535, 65535, 65535, -128, -128, 65535, 65535), strict=True))
    real = dict(zip(STATUS, (12450, 0, 15174, 21, -67, 0, 65534), strict=True))
    rows = raw(spark, {**silent, "health_state": 31, "reboot_count": 7}, {**real, "seq": 2, "health_state": 0, "reboot_count": 0})
    got = collect(rawrows.typed("status", rows, basis).orderBy("seq"), *STATUS, "health_state", "reboot_count")
    assert got == [(None,) * 7 + (31, 7), (12450, 0, 15174, 21, -67, 0, 65534, 0, 0)]


def test_engine_poll_sentinels_by_width(spark, basis):
    cols = ("speed_kph", "rpm", "fuel_pressure_kpa", "throttle_pct", "load_pct", "coolant_c", "intake_c", "timing_advance_deg")
    silent = dict(zip(cols, (-32768, -32768, 65535, 255, 255, -128, -128, -128), strict=True))
    # The sentinel of another width is a reading, and so are zeroes.
    real = dict(zip(cols, (-128, 255, 255, 0, 254, 0, -127, 127), strict=True))
    rows = raw(spark, {**silent, "poll_cadence_ms": 0}, {**real, "seq": 2, "poll_cadence_ms": 250})
    got = collect(rawrows.typed("obd", rows, basis).orderBy("seq"), *cols, "poll_cadence_ms", "pids_requested")
    assert got == [(None,) * 10, (-128, 255, 255, 0, 254, 0, -127, 127, 250, None)]


def test_boost_needs_both_pressures_and_a_pedal_needs_its_schema(spark, basis):
    def one(seq, **fields):
        return {"seq": seq, "map_kpa": 200, "baro_kpa": 100, "lambda_e4": 10_000, "pedal_pct": 0, "schema_version": 2, **fields}

    rows = raw(spark, one(1), one(2, map_kpa=65535), one(3, baro_kpa=255), one(4, lambda_e4=65535), one(5, schema_version=1), one(6, pedal_pct=255), one(7, schema_version=None))
    got = collect(rawrows.typed("boost", rows, basis).orderBy("seq"), F.round("boost_psi", 4), "lambda_ratio", "pedal_pct")
    psi = 14.5038
    assert got == [(psi, 1.0, 0), (None, 1.0, 0), (None, 1.0, 0), (psi, None, 0), (psi, 1.0, None), (psi, 1.0, None), (psi, 1.0, None)]


def test_clock_scores_and_gyro(spark, basis):
    shift = {"start_score_e2": 250, "stop_score_e2": 0, "wake_cause": 4294967295, "region": 4}
    got = collect(rawrows.typed("transition", raw(spark, shift), basis), "observed_at", "start_score", "stop_score", "wake_cause", "to_state")
    assert got == [(at(1000), 2.5, 0.0, 4294967295, None)]
    assert collect(rawrows.typed("imu", raw(spark, {"gyro_peak_dps_e1": -125}), basis), "gyro_peak_dps") == [(-12.5,)]
    fix = {"lat_e7": 1, "lon_e7": 2, "speed_cmps": 5000, "fix_type": 3, "heading_cdeg": 0, "utc_offset_ms": -250, "v_acc_cm": 65535, "utc_acc_ms": 65534, "sats_visible": 255}
    got = collect(rawrows.typed("position", raw(spark, fix), basis), "observed_at", "lat", "v_acc_m", "utc_acc_ms", "sats_visible", "hdop")
    assert got == [(at(750), 1e-7, None, 65534, None, None)]
    # A bundle without a basis keeps its rows.
    other = raw(spark, {"content_root": "x", "gyro_peak_dps_e1": 10})
    assert collect(rawrows.typed("imu", other, basis), "observed_at", "gyro_peak_dps") == [(None, 1.0)]
    seen = raw(spark, {"utc_ms": 900, "accuracy_ms": 4294967295, "source_code": 9, "flags": 3}, {"seq": 2, "utc_ms": 5000, "accuracy_ms": 0, "source_code": 1, "flags": 2})
    got = collect(rawrows.typed("time_obs", seen, basis).orderBy("seq"), "implied_basis_ms", "accuracy_ms", "source", "adopted")
    assert got == [(None, None, "unknown(9)", True), (4000, 0, "gnss", False)]


def test_undefined_values_are_flaws_not_rows(spark, basis):
    fix = {"lat_e7": 1, "lon_e7": 2, "speed_cmps": 0, "fix_type": 3, "heading_cdeg": 35999}
    fixes = raw(spark, fix, {**fix, "seq": 2, "fix_type": 6, "heading_cdeg": 36000}, {**fix, "seq": 3, "fix_type": 0}, {**fix, "seq": 4, "speed_cmps": 5001}, {**fix, "seq": 5, "lat_e7": 0, "lon_e7": 0})
    gaps = raw(spark, *[{"seq": i, "duration_ms": 10, "cause": i} for i in range(7)])
    tables, flawed = rawrows.typed_tables({"position": fixes, "gap": gaps, "marker": fixes}, basis)
    assert collect(tables.position, "seq") == [(1,)] and tables.marker is fixes
    assert [r[0] for r in collect(tables.gap.orderBy("seq"), "seq")] == [1, 2, 3, 4, 5]
    assert sorted(collect(flawed, "kind", "seq", "warning")) == [
        ("gap", 0, "cause 0"), ("gap", 6, "cause 6"), ("position", 2, "fix_type 6"), ("position", 2, "heading 36000"),
    ]


@pytest.mark.parametrize("table", sorted(rawrows.FIELDS))
def test_empty_tables_and_sparse_inputs_have_the_schema(spark, basis, table):
    needed = {"position": ("fix_type", "lat_e7", "lon_e7", "speed_cmps", "heading_cdeg"), "gap": ("cause",), "time_obs": ("utc_ms", "source_code")}.get(table, ())
    empty = raw(spark, dict.fromkeys(needed, 1)).where("false")
    got = rawrows.typed(table, empty, basis)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in SAMPLE_TABLES[table]] and got.count() == 0


def test_records_are_loaded_with_their_flaws_in_one_batch(spark, make, tmp_path):
    fix = {"lat_e7": 340000000, "lon_e7": -1180000000, "speed_cmps": 1000, "fix_type": 3, "heading_cdeg": 0}
    fixes = [{**fix, "mono_ms": 1000 * i, "seq": i, "lat_e7": fix["lat_e7"] + 1000 * i} for i in range(30)]
    fixes[7]["fix_type"] = 9
    listed = [{"content_root": "r", "vehicle_id": "v", "device_id": "d", "boot_id": "A"}]
    tables = make(bundles=listed)
    polls = [{"mono_ms": 1000 * i, "seq": 100 + i, "speed_kph": 36 if i else -32768, "rpm": 1500} for i in range(30)]
    given = {**{n: tables[n] for n in tables}, "position": raw(spark, *fixes), "obd": raw(spark, *polls), "bundles": tables.bundles.withColumn("utc_basis_ms", F.lit(BASE))}
    given = {n: f for n, f in given.items() if n in ("position", "obd", "bundles") or n not in rawrows.FIELDS} | {
        n: raw(spark, {"cause": 1} if n == "gap" else {}).where("false") for n in ("imu", "boost", "status", "transition", "gap")
    }
    for batch in (0, 1):
        load.load_records(given, str(tmp_path), batch)
    stored = lambda n: load.loaded(spark, str(tmp_path), n)
    assert stored("position").count() == 29 and stored("obd").where("speed_kph IS NULL").count() == 1
    assert collect(stored("warnings"), "kind", "seq", "warning") == [("position", 7, "fix_type 9")]
    assert collect(stored("trips"), "started_at", "sample_count") == [(at(0), 29)]
