"""Views against hand-computed answers."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from odolake.plans import catalog, engine, insight, power, repair, summaries, tracks, trips, trusted, wifi
from tests.conftest import at, collect, row


def test_telemetry_takes_the_latest_reading_and_its_age(make):
    t = make(
        obd=[row(boot=b, ms=m) for b, m in (("A", 999), ("A", 1000), ("A", 1900), ("A", 2500), ("B", 400), ("B", 600))],
        boost=[row(boot="A", ms=1000, boost_psi=5.0), row(boot="A", ms=2000, boost_psi=9.0), row(boot="B", ms=500, boost_psi=1.5)],
    )
    got = sorted(collect(engine.v_telemetry(t), "boot_id", "mono_ms", "boost_psi", "boost_age_ms"))
    assert got == [
        ("A", 999, None, None), ("A", 1000, 5.0, 0), ("A", 1900, 5.0, 900), ("A", 2500, 9.0, 500),
        ("B", 400, None, None), ("B", 600, 1.5, 100),
    ]


def test_telemetry_keeps_a_null_reading_null(make):
    t = make(obd=[row(ms=100)], boost=[row(ms=10, boost_psi=5.0), row(ms=50, boost_psi=None, map_kpa=100)])
    assert collect(engine.v_telemetry(t), "boost_psi", "map_kpa", "boost_age_ms") == [(None, 100, 50)]


def test_telemetry_reaches_across_hours_and_breaks_ties_by_sequence(make):
    t = make(
        obd=[row(ms=10_000_000), row(ms=20_000_000)],
        boost=[row(ms=5, seq=1, boost_psi=1.0), row(ms=5, seq=2, boost_psi=2.0), row(ms=20_000_000, seq=3, boost_psi=3.0)],
    )
    got = sorted(collect(engine.v_telemetry(t), "mono_ms", "boost_psi", "boost_age_ms"))
    assert got == [(10_000_000, 2.0, 9_999_995), (20_000_000, 3.0, 0)]


def test_drive_summary(make):
    t = make(
        obd=[row(ms=m, speed_kph=s, rpm=r) for m, s, r in ((1000, 60, 2000), (5000, 80, 4000), (11000, 40, 3000))] + [row(boot="B", ms=5)],
        position=[row(ms=1, fix_type=3), row(ms=2, fix_type=0), row(ms=3, fix_type=3, source_flags=32)],
        gap=[{"vehicle_id": "v", "boot_id": "A", "seq": 1, "duration_ms": 42000}],
    )
    cols = ["duration_s", "max_speed_kph", "max_rpm", "obd_samples", "gnss_samples", "fix_samples", "phone_samples", "gap_count", "gap_duration_ms", "warnings"]
    got = {r[0]: r[1:] for r in collect(summaries.v_drive_summary(t), "boot_id", *cols)}
    assert got["A"] == (10.0, 80, 4000, 3, 2, 1, 1, 1, 42000, None)
    assert got["B"][3:] == (1, 0, 0, 0, 0, 0, None)


def test_trim_map_uses_fresh_readings_only(make):
    obd = [row(ms=m, rpm=r, load_pct=p) for m, r, p in ((1000, 2200, 45), (2000, 2700, 55), (3000, 3100, 45), (9000, 900, 10))]
    boost = [row(ms=m, stft_pct=s, ltft_pct=1) for m, s in ((500, 2), (1800, 4), (2800, 6), (4000, 8))]
    got = sorted(collect(engine.v_trim_map(make(obd=obd, boost=boost)), "rpm_bin", "load_bin", "avg_stft", "samples"))
    assert got == [(2000, 40, 2.0, 1), (2500, 50, 4.0, 1), (3000, 40, 6.0, 1)]


def test_boost_curve_drops_a_saturated_poll_instead_of_looking_back(make):
    obd = [row(ms=m, rpm=r) for m, r in ((1000, 3000), (2000, 4000), (3000, 5000))]
    boost = [row(ms=m, boost_psi=10.0, map_kpa=k) for m, k in ((900, 200), (1900, 255), (2900, 230))]
    assert sorted(collect(engine.v_boost_curve(make(obd=obd, boost=boost)), "rpm", "map_kpa")) == [(3000, 200), (5000, 230)]


def test_pulls(make):
    obd = [row(ms=1000 * i, throttle_pct=th, rpm=r) for i, (th, r) in enumerate([(20, 2000), (85, 2500), (90, 3500), (95, 4200), (15, 2000)])]
    boost = [row(ms=1000 * i, boost_psi=p, map_kpa=k) for i, (p, k) in enumerate([(1.0, 101), (8.0, 150), (12.0, 180), (14.0, 200), (30.0, 210)])]
    got = collect(engine.v_pulls(make(obd=obd, boost=boost)), "min_rpm", "max_rpm", "obd_samples", "peak_boost_psi", "duration_s")
    assert got == [(2500, 4200, 3, 14.0, 2.0)]
    flat = [row(ms=1000 * i, throttle_pct=90, rpm=2000 + 100 * i) for i in range(4)]
    assert engine.v_pulls(make(obd=flat)).count() == 0


def test_a_pull_may_cross_any_number_of_minutes(make):
    obd = [row(ms=30_000 * i, throttle_pct=90 if i else 10, rpm=1000 + 10 * i) for i in range(200)]
    assert collect(engine.v_pulls(make(obd=obd)), "start_ms", "end_ms", "obd_samples") == [(30_000, 5_970_000, 199)]


def test_speed_agreement(make):
    t = make(obd=[row(ms=1000, speed_kph=100)], position=[row(ms=800, speed_mps=27.78, fix_type=3)])
    ratio, age = collect(engine.v_speed_agreement(t), "ratio", "gnss_age_ms")[0]
    assert age == 200 and ratio == pytest.approx(1, abs=0.001)
    t = make(obd=[row(ms=1000, speed_kph=100)], position=[row(ms=800, speed_mps=27.78, fix_type=0)])
    assert engine.v_speed_agreement(t).count() == 0


def test_gnss_sources(make):
    t = make(position=[row(ms=1000, seq=1, fix_type=3, source_flags=32, lat=1.0), row(ms=1400, seq=2, fix_type=3, lat=2.0), row(ms=1500, seq=3, fix_type=3, lat=3.0)])
    assert collect(engine.v_gnss_sources(t), "internal_lat", "phone_lat", "time_offset_ms") == [(2.0, 1.0, 400)]


def verdicts(t):
    return [r[1] for r in sorted(collect(trusted.v_position_trusted(t), "mono_ms", "trusted"))]


def test_a_fast_fix_of_a_still_car_is_not_trusted(make):
    t = make(
        position=[row(ms=1000 * s, speed_mps=15.0) for s in range(10)] + [row(ms=1000 * s, speed_mps=42.0) for s in range(20, 25)],
        imu=[row(ms=1000 * s, accel_rms_mg=120) for s in range(10)] + [row(ms=1000 * s, accel_rms_mg=9) for s in range(20, 25)],
    )
    assert verdicts(t) == [True] * 10 + [False] * 5


def test_a_jump_in_speed_discredits_both_ends(make):
    t = make(position=[row(ms=1000 * i, speed_mps=float(v)) for i, v in enumerate([12, 13, 14, 40, 13, 12])])
    assert verdicts(t) == [True, True, False, False, False, True]


def test_the_rules_hold_across_a_minute_edge(make):
    t = make(position=[row(ms=57_500 + 1000 * i, speed_mps=float(v)) for i, v in enumerate([12, 13, 14, 40, 13, 12])])
    assert verdicts(t) == [True, True, False, False, False, True]


def test_satellites_and_wheels(make):
    fixes, polls = [], []
    for s in range(10):
        polls.append(row(ms=s * 1000 + 500, speed_kph=5))
        fixes.append(row(ms=s * 1000, speed_mps=1.4, sats_used=12))
    for s in range(10, 20):
        polls.append(row(ms=s * 1000 + 500, speed_kph=5))
        fixes.append(row(ms=s * 1000, speed_mps=8.0, sats_used=4 if s >= 15 else 9))
    for s in range(30, 40):
        polls.append(row(ms=s * 1000 + 500, speed_kph=(s - 30) * 20))
        fixes.append(row(ms=s * 1000, speed_mps=(s - 30) * 20 / 3.6 + 2.0, sats_used=11))
    assert verdicts(make(position=fixes, obd=polls)) == [True] * 10 + [False] * 10 + [True] * 10


def test_a_phantom_run_opens_no_leg_and_sets_no_maximum(make):
    base = "2026-10-15T03:00:00"
    real, phantom = range(10), range(300, 305)
    t = make(
        position=[row(ms=1000 * s, when=at(1000 * s, base), lat=34.0, lon=-118.0, fix_type=3, speed_mps=15.0) for s in real]
        + [row(ms=1000 * s, when=at(1000 * s, base), lat=34.1, lon=-118.1, fix_type=3, speed_mps=45.0) for s in phantom],
        imu=[row(ms=1000 * s, when=at(1000 * s, base), accel_rms_mg=120) for s in real]
        + [row(ms=1000 * s, when=at(1000 * s, base), accel_rms_mg=9) for s in phantom],
    )
    assert trips.v_trip_leg(t).count() == 1
    assert collect(trips.v_trip_summary(t), "max_gnss_speed_mps", "leg_count") == [(15.0, 1)]


def drive(boot, start, seconds):
    pos = [row(boot=boot, ms=1000 * i, when=at(1000 * i, start), lat=34.0 + i * 0.001, lon=-118.4, speed_mps=11.0, fix_type=3) for i in range(seconds)]
    obd = [row(boot=boot, ms=1000 * i, when=at(1000 * i, start), speed_kph=40) for i in range(seconds)]
    return pos, obd


def test_an_errand_over_two_boots_is_one_trip(make):
    parts = [drive("a", "2026-10-09T03:28:29", 423), drive("b", "2026-10-09T03:45:25", 737), drive("b", "2026-10-09T04:04:39", 759)]
    status = [row(boot="b", ms=30_000 * i, when=at(30_000 * i, "2026-10-09T04:17:18"), battery_mv=12400) for i in range(840)]
    t = make(position=[r for p, _ in parts for r in p], obd=[r for _, o in parts for r in o], status=status)
    got = collect(trips.v_trip_summary(t), "started_at", "ended_at", "duration_ms", "leg_count", "boot_id", "trip_id")
    assert len(got) == 1
    start, end, took, legs, boot, trip_id = got[0]
    assert (str(start), str(end), took, legs, boot) == ("2026-10-09 03:28:29", "2026-10-09 04:17:17", 2_928_000, 3, "a")
    assert trip_id == "v:1791516509000"


def test_a_two_hour_stop_splits_the_trip(make):
    parts = [drive("b", "2026-10-09T03:00:00", 120), drive("b", "2026-10-09T05:00:00", 120)]
    t = make(position=[r for p, _ in parts for r in p], obd=[r for _, o in parts for r in o])
    assert trips.v_trip_summary(t).count() == 2


@pytest.mark.parametrize(("gap_ms", "count"), [(3_600_000, 1), (3_600_001, 2)])
def test_an_hour_exactly_still_belongs_to_the_trip(make, gap_ms, count):
    t = make(imu=[row(ms=0, when=at(59_999)), row(ms=1, when=at(59_999 + gap_ms))])
    assert trips.v_trip_summary(t).count() == count


@pytest.mark.parametrize(("gap_ms", "count"), [(60_000, 1), (60_001, 2)])
def test_a_leg_breaks_after_more_than_a_minute(make, gap_ms, count):
    t = make(obd=[row(ms=0, when=at(17), speed_kph=50), row(ms=1, when=at(17 + gap_ms), speed_kph=50)])
    assert trips.v_trip_leg(t).count() == count


def test_distance_bridges_five_seconds_only(make):
    step = 0.001  # about 111 m
    at_s = [0, 1, 6, 12]
    t = make(position=[row(ms=1000 * s, when=at(1000 * s), lat=34.0 + step * i, lon=-118.0, fix_type=3, speed_mps=20.0) for i, s in enumerate(at_s)])
    (metres,) = collect(trips.v_trip_summary(t), "distance_m")[0]
    assert metres == pytest.approx(2 * 6371000 * math.radians(step), rel=1e-6)


def periods(spark):
    rows = [("v", dt.datetime(2026, 2, 28, 23, 50), 600_000, 5000.0, 50, 20.0), ("v", dt.datetime(2026, 3, 1), 60_000, 1000.0, 30, 10.0),
            ("w", dt.datetime(2026, 12, 31, 12), 1000, None, None, None)]
    df = spark.createDataFrame(rows, "vehicle_id string, started_at timestamp_ntz, duration_ms bigint, distance_m double, max_obd_speed_kph int, max_gnss_speed_mps double")
    return trips.v_trip_period(df.selectExpr("*", "started_at AS ended_at", "'b' AS boot_id"))


def test_calendar_periods(spark):
    got = sorted(collect(periods(spark), "started_on", "week_start", "month_start", "quarter_start", "year_start"))
    d = dt.date
    assert got[0] == (d(2026, 2, 28), d(2026, 2, 23), d(2026, 2, 1), d(2026, 1, 1), d(2026, 1, 1))
    assert got[2] == (d(2026, 12, 31), d(2026, 12, 28), d(2026, 12, 1), d(2026, 10, 1), d(2026, 1, 1))


def test_period_summary_is_half_open_in_python_and_sql(spark):
    p = periods(spark)
    assert collect(trips.period_summary(p, "2026-03-01", "2026-04-01"), "vehicle_id", "trips", "duration_ms", "distance_m") == [("v", 1, 60_000, 1000.0)]
    assert trips.period_summary(p, "2026-04-01", "2026-03-01").count() == 0
    p.createOrReplaceTempView("v_trip_period")
    trips.register_period_summary(spark)
    got = spark.sql("SELECT vehicle_id, trips, distance_m FROM period_summary('2026-02-01', '2027-01-01') ORDER BY 1").collect()
    assert [tuple(r) for r in got] == [("v", 2, 6000.0), ("w", 1, 0.0)]


def boot_of(vehicle, boot, start, pulls, psi, lam, ltft, stft):
    obd, boost = [], []
    for p in range(pulls):
        for i, (th, rpm) in enumerate([(10, 1000), (90, 2000), (95, 3000), (10, 1000)]):
            ms = 10_000 * p + 1000 * i
            obd.append(row(vehicle, boot, ms, when=at(ms, start), throttle_pct=th, rpm=rpm))
        boost.append(row(vehicle, boot, 10_000 * p + 1500, when=at(10_000 * p + 1500, start), boost_psi=float(psi), lambda_ratio=lam, map_kpa=200))
    for i in range(25):
        ms = 500_000 + 1000 * i
        boost.append(row(vehicle, boot, ms, when=at(ms, start), ltft_pct=ltft, stft_pct=stft))
    return obd, boost


def test_tune_effect(make):
    boots = [("b1", "2026-07-01", 2, 15, 0.95, 8), ("b2", "2026-07-10", 2, 16, 0.96, 9), ("b3", "2026-07-20", 2, 17, 0.97, 10),
             ("b4", "2026-08-01", 3, 19, 0.90, 3), ("b5", "2026-08-09", 3, 21, 0.88, 2)]
    parts = [boot_of("v", b, f"{d}T09:00:00", n, psi, lam, lt, 0) for b, d, n, psi, lam, lt in boots]
    t = make(obd=[r for o, _ in parts for r in o], boost=[r for _, b in parts for r in b], tune=[{"vehicle_id": "v", "tune_id": "t1", "tuned_at": dt.datetime(2026, 8, 1)}])
    got = {r[0]: r[1:] for r in collect(insight.v_tune_effect(t), "metric", "before_median", "after_median", "before_n", "after_n")}
    assert len(got) == 4
    assert got["boost_psi"] == (16.0, 20.0, 6, 6)
    assert got["ltft_pct"] == (9.0, 2.5, 3, 2)
    assert got["lambda"] == pytest.approx((0.96, 0.89, 6, 6))


def test_wifi_places(make):
    home = 34.0280, -118.4527
    scans, aps, fixes = [], [], []

    def scan(boot, ms, seq, flags, *heard):
        scans.append(row(boot=boot, ms=ms, seq=seq, flags=flags, ap_count=len(heard)))
        aps.extend(row(boot=boot, ms=ms, seq=seq, bssid=b, rssi_dbm=r) for b, r in heard)

    def fix(boot, ms, seq, lat, lon, speed):
        fixes.append(row(boot=boot, ms=ms, seq=seq, lat=lat, lon=lon, fix_type=3, speed_mps=speed, sats_used=12))

    for i in range(3):
        fix("A", 10_000 + 60_000 * i - 500, i, home[0] + 0.00002 * i, home[1], 0.0)
        scan("A", 10_000 + 60_000 * i, 100 + i, 1, ("h1", -50), ("h2", -60))
    scan("A", 70_000, 200, 1, ("once", -70))
    for ms, seq, north in ((300_000, 10, 0.0), (400_000, 11, 0.02)):
        fix("A", ms, seq, home[0] + north, home[1], 0.0)
        scan("A", ms + 400, 290 + seq, 1, ("bus", -65))
    scan("B", 5000, 1, 2, ("h1", -55), ("h2", -62))
    scan("B", 15_000, 2, 2, ("strange", -80))
    fix("B", 600_000, 1, home[0] + 0.0005, home[1], 12.0)
    scan("B", 601_000, 3, 3, ("h1", -90))
    t = make(position=fixes, wifi_scan=scans, wifi_ap_obs=aps)
    assert sorted(r[0] for r in collect(wifi.v_wifi_ap_learned(t), "bssid")) == ["h1", "h2"]
    got = {(r[0], r[1]): r[2:] for r in collect(wifi.v_wifi_scan_unfixed(t), "boot_id", "seq", "est_lat", "est_lon", "est_aps")}
    lat, lon, n = got["B", 1]
    assert n == 2 and math.hypot((lat - home[0]) * 111320, (lon - home[1]) * 111320 * math.cos(math.radians(home[0]))) < 10
    assert got["B", 2][0] is None
    assert ("B", 3) not in got


def step(ms, seq, enter, reason=0):
    return row(ms=ms, seq=seq, root="r", region=4, trigger_event=4, from_state=0 if enter else 1, to_state=1 if enter else 0, reason_code=reason)


def test_standby_windows(make):
    t = make(transition=[step(1000, 1, True), step(21_661_000, 2, False, 3)])
    assert collect(power.power_windows(t), "duration_ms", "wake_reason_name", "unmatched") == [(21_660_000, "periodic health", False)]
    t = make(transition=[step(1, 1, False), step(1000, 2, True), step(2000, 3, True), step(5000, 4, False)])
    assert sorted(collect(power.power_windows(t), "enter_ms", "duration_ms", "unmatched")) == [(1000, 0, True), (2000, 3000, False)]
    wrapped = make(transition=[step(4_294_967_000, 1, True), step(704, 2, False)])
    assert collect(power.power_windows(wrapped), "duration_ms") == [(1000,)]


def test_voltage_drain_needs_ten_minutes(make):
    hours = 12 * 3_600_000
    t = make(status=[row(ms=0, root="r", battery_mv=12_600), row(ms=hours // 2, root="r"), row(ms=hours, root="r", battery_mv=12_480)])
    assert collect(power.power_summary(t), "drop_mv", "drain_mv_per_hour", "voltage_samples") == [(120, -10.0, 2)]
    t = make(status=[row(ms=0, root="r", battery_mv=12_600), row(ms=599_999, root="r", battery_mv=13_000)])
    assert collect(power.power_summary(t), "drop_mv", "drain_mv_per_hour") == [(-400, None)]


def test_two_cars_with_the_same_boots_do_not_mix(make):
    def both(make_row):
        return [make_row("v1", 1), make_row("v2", 2)]

    t = make(
        obd=both(lambda v, k: row(v, ms=1000, when=at(1000), rpm=2200, load_pct=45, speed_kph=36)),
        boost=both(lambda v, k: row(v, ms=900, when=at(900), boost_psi=8.0 * k, stft_pct=k, ltft_pct=-k, map_kpa=150)),
        position=both(lambda v, k: row(v, ms=900, when=at(900), speed_mps=10.0, fix_type=3, lat=34.0 + k, lon=-118.0)),
        bundles=[{"vehicle_id": f"v{k}", "content_root": f"r{k}", "boot_id": "A"} for k in (1, 2)],
    )
    assert sorted(collect(engine.v_telemetry(t), "vehicle_id", "boost_psi", "lat")) == [("v1", 8.0, 35.0), ("v2", 16.0, 36.0)]
    assert sorted(collect(engine.v_trim_map(t), "vehicle_id", "avg_stft", "avg_ltft")) == [("v1", 1.0, -1.0), ("v2", 2.0, -2.0)]
    for name in catalog.views(t):
        if name.startswith("v_") and "vehicle_id" in catalog.views(t)[name].columns:
            whole = catalog.views(t)[name]
            alone = catalog.views(type(t)({n: t[n].where("vehicle_id = 'v1'") for n in t}))[name]
            order = sorted(whole.columns)
            key = repr
            assert sorted(map(key, collect(whole.where("vehicle_id = 'v1'"), *order))) == sorted(map(key, collect(alone, *order))), name


def test_every_view_is_empty_on_empty_tables(make):
    found = catalog.views(make())
    for name in found:
        assert found[name].count() == 0, name


def test_views_can_be_used_from_sql(spark, make):
    catalog.register(spark, make(obd=[row(ms=1000, when=at(0), speed_kph=40)], position=[row(ms=900, when=at(0), lat=1.0, lon=2.0)]))
    assert spark.sql("SELECT lat FROM v_telemetry").collect()[0][0] == 1.0
    assert spark.sql("SELECT trips FROM period_summary('2026-01-01', '2026-01-02')").collect()[0][0] == 1


def test_bundle_surfaces_can_be_used_from_sql(spark, make):
    fixes = [row(ms=1000 * i, when=at(1000 * i), root="r", lat=38.0 + i / 1000, lon=-120.0, fix_type=3, speed_mps=15.0, source_flags=0) for i in range(120)]
    t = make(
        position=fixes, obd=[row(ms=1000 * i, seq=5000 + i, when=at(1000 * i), root="r", speed_kph=54, rpm=2000) for i in range(120)],
        gap=[{"vehicle_id": "v", "content_root": "r", "boot_id": "A", "seq": 9000, "started_at": at(5000), "duration_ms": 9000, "cause": 1}],
        bundles=[{"content_root": "r", "vehicle_id": "v", "device_id": "d", "boot_id": "A"}],
    )
    learned = spark.createDataFrame([("d", "v")], "device_id string, vehicle_id string")
    catalog.register(spark, t, fitted=learned)
    one = lambda text: [tuple(r) for r in spark.sql(text).collect()]
    assert one("SELECT t.device_id, r.trip_count, r.event_count > 0 FROM daily_rollups r JOIN bundle_trips t ON t.started_at::DATE = r.day") == [("d", 1, True)]
    assert one("SELECT cause_name FROM trip_gaps JOIN bundle_trips USING (trip_id)") == [("no_fix",)]
    assert one("SELECT count(*) > 0 FROM trip_segments") == [(True,)]
    assert one("SELECT count(*) FROM trip_events WHERE device_id = 'd' AND kind IN ('trip.started', 'trip.ended')") == [(2,)]
    # A track carries the id of the published trip.
    assert one("SELECT count(*), max(run_no) FROM v_trip_track JOIN v_trip_publish ON trip_id = entity_id") == [(120, 0)]
    assert one("SELECT points FROM v_trip_track_runs") == [(120,)] and one("SELECT * FROM v_trip_track_gaps") == []
    assert one("SELECT * FROM v_wifi_anchors") == []
    assert "v_health_findings" not in catalog.views(t) and "v_wifi_anchors" not in catalog.views(t)


def test_track_runs_gaps_and_line(spark, make):
    places = [(38.5, -120.2, 0), (40.7, -120.95, 10), (43.252, -126.453, 20)]
    t = make(position=[row(ms=1000 * s, when=at(1000 * s), lat=a, lon=o, fix_type=3, source_flags=0) for a, o, s in places]
             + [row(ms=60_000, when=at(60_000), lat=1.0, lon=1.0, fix_type=3, source_flags=0),
                row(ms=61_000, when=at(61_000), lat=1.0, lon=1.0, fix_type=3, source_flags=None)])
    spans = spark.createDataFrame([("v", "trip", at(0), at(100_000))], "vehicle_id string, trip_id string, started_at timestamp_ntz, ended_at timestamp_ntz")
    points = tracks.track_points(trusted.v_position_trusted(t), spans)
    runs = sorted(collect(tracks.track_runs(points), "run_no", "points", "polyline"))
    assert runs[0] == (0, 3, "_p~iF~ps|U_ulLnnqC_mqNvxq`@")  # the documented example of the encoding
    assert runs[1][:2] == (1, 1)
    assert collect(tracks.track_gaps(points), "duration_ms") == [(40_000,)]


def test_speed_sentinel(make):
    t = make(obd=[row(ms=1, speed_kph=255, rpm=0), row(ms=2, speed_kph=255, rpm=900), row(ms=3, speed_kph=0, rpm=0), row(ms=4, speed_kph=255)])
    got = sorted(collect(repair.clear_unavailable_speed(t.obd), "mono_ms", "speed_kph"))
    assert got == [(1, None), (2, 255), (3, 0), (4, 255)]
