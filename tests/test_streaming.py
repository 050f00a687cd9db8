"""Streams that arrive in several batches give what the batch views give."""

from __future__ import annotations

import contextlib
import os

import pyarrow as pa
from pyspark.sql import functions as F

from odolake.plans import power, registry, repair, synclog
from odolake.streaming import carried, flows, stateful
from tests.conftest import at, collect, row


def fed(spark, batches, flow, folder):
    """Feed the frames one batch after the other, each of them twice as after a failure, and return everything that came out."""
    step = flow(str(folder))
    for n, df in enumerate(batches):
        for _ in range(2):
            step(df, n)
    return carried.results(spark, str(folder))


def test_standby_and_gate_keep_their_state_between_batches(spark, make, tmp_path):
    def step(ms, seq, enter):
        return row(ms=ms, seq=seq, root="r", region=4, trigger_event=4, from_state=0 if enter else 1, to_state=1 if enter else 0, reason_code=1)

    t = make(transition=[step(1000, 1, True), step(2000, 2, True), step(9000, 3, False), step(9500, 4, True)])
    halves = [t.transition.where("seq <= 2"), t.transition.where("seq > 2")]
    got = collect(fed(spark, halves, stateful.standby_windows, tmp_path / "a"), "enter_ms", "exit_ms", "unmatched")
    closed = power.power_windows(t).where("enter_ms < 9500")
    assert sorted(got, key=repr) == sorted(collect(closed, "enter_ms", "exit_ms", "unmatched"), key=repr)

    fixes = [row(ms=1000 * i, seq=i, root="r", lat=None if i == 6 else 34.0 + (0.1 if 3 <= i < 12 and i != 7 else 0), lon=-118.0) for i in range(20)]
    t = make(position=fixes, gap=[{"vehicle_id": "v", "content_root": "r", "boot_id": "A", "seq": 15}])
    rows = t.position.select("content_root", "seq", "mono_ms", "lat", "lon", F.lit(False).alias("is_gap")).unionByName(
        t.gap.select("content_root", "seq", F.lit(True).alias("is_gap")), allowMissingColumns=True
    )
    parts = [rows.where("seq < 5"), rows.where("seq BETWEEN 5 AND 9"), rows.where("seq > 9")]
    got = sorted(collect(fed(spark, parts, stateful.jump_gate, tmp_path / "b"), "seq"))
    assert got == sorted(collect(repair.jump_gate(t.position, t.gap), "seq"))


def test_counters_and_revisions_go_on_from_the_last_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(carried, "TOGETHER", 3)
    offers = [("d", 1, "a"), ("d", 2, "b"), ("d", 9, "c"), ("e", 4, "a"), ("d", 2, "b"), ("d", 2, "x"), ("d", 5, "y"), ("e", 0, "z"), ("d", 12, "q"), ("e", 4, "a"), (None, 3, "n")]
    frame = spark.createDataFrame([(*o, i) for i, o in enumerate(offers)], "device_id string, counter bigint, content_root string, arrival bigint")
    whole = sorted(collect(registry.counter_verdicts(frame.where("device_id IS NOT NULL")), "arrival", "verdict", "gap"))
    parts = [frame.where(F.col("arrival").between(2 * n, 2 * n + 1)) for n in range(6)]
    assert sorted(collect(fed(spark, parts, stateful.counter_guard, tmp_path / "c"), "arrival", "verdict", "gap")) == whole
    assert os.path.exists(tmp_path / "c" / "owners" / "whole" / "batch=3") and len(whole) == 10

    ops = [("k", "v", f"t{i % 3}", i, ["a", "b"] if i % 4 == 0 else ["a"], [i // 3] * (2 if i % 4 == 0 else 1)) for i in range(40)]
    schema = "kind string, vehicle_id string, target string, arrival bigint, fields array<string>, base array<bigint>"
    frame = spark.createDataFrame(ops, schema)
    whole = sorted(collect(synclog.field_revisions(frame), "arrival", "status", "revisions"))
    parts = [frame.where(F.col("arrival").between(8 * n, 8 * n + 7)) for n in range(5)]
    assert sorted(collect(fed(spark, parts, stateful.field_revisions, tmp_path / "r"), "arrival", "status", "revisions")) == whole


def test_a_key_of_a_million_rows_is_read_as_a_stream(spark, tmp_path):
    n = 1_000_000
    place = F.lit(34.0) + F.col("id") * 1e-6 + F.when(F.col("id") % 100 == 50, 1.0).otherwise(0.0)
    rows = spark.range(n).select(
        F.lit("r").alias("content_root"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("mono_ms"), place.alias("lat"), F.lit(-118.0).alias("lon"), F.lit(False).alias("is_gap")
    )
    stateful.jump_gate(str(tmp_path))(rows, 0)
    stateful.jump_gate(str(tmp_path))(rows.limit(1).select("content_root", F.lit(n).cast("long").alias("seq"), F.lit(n * 1000).cast("long").alias("mono_ms"), F.lit(40.0).alias("lat"), "lon", "is_gap"), 1)
    got = carried.results(spark, str(tmp_path))
    assert got.count() == n - n // 100 and got.where("seq % 100 = 50 OR batch = 1").count() == 0
    # One row at a time: rows are taken from an iterator, and a batch is handed on before the next is read.
    seen = []
    types = spark.createDataFrame([], "content_root string, seq long, mono_ms long, lat double, lon double, _k0 string, _state string").schema
    walk = carried._stream(["content_root"], stateful.JumpGate, types.names[:5], types)
    piece = pa.RecordBatch.from_pylist([{"content_root": "r", "seq": 1, "mono_ms": 1, "lat": 1.0, "lon": 1.0, "is_gap": False, "_turn": 1, "_state": None}])

    def source():
        for i in range(3):
            seen.append(i)
            yield piece

    assert [(len(seen), b.num_rows) for b in walk(source())] == [(1, 1), (2, 1), (3, 1), (3, 1)]


def test_a_bundle_delivered_twice_counts_once(spark, tmp_path):
    def batch(*roots):
        return spark.createDataFrame([(r, at(ms)) for r, ms in roots], "content_root string, received_at timestamp_ntz")

    day = 86_400_000
    accept = flows.intake(str(tmp_path))
    accept(batch(("a", 99 * day), ("b", 99 * day), ("a", 99 * day)), 0)
    for _ in range(2):  # the second batch is run again after a failure
        accept(batch(("b", 0), ("c", 0), (None, 0)), 1)
    accept(batch(("a", 400 * day)), 2)
    got = spark.read.parquet(f"{tmp_path}/accepted")
    assert sorted(collect(got, "content_root", "batch")) == [("a", 0), ("b", 0), ("c", 1)]


def test_late_data_rekeys_a_trip_in_the_feed(spark, tmp_path):
    hour = 3_600_000
    batches = [[("v", 9 * hour)], [("v", 8 * hour + 1)], [("w", 1)], [("v", 8 * hour + 1)], [("w", 0), ("w", 99 * hour)]]

    def describe(found):
        return synclog.entity_state(found.selectExpr("*", "concat(vehicle_id, ':', lo) AS id"), "trip", "id", "vehicle_id", ["lo", "hi"])

    outing, publish = flows.outings(f"{tmp_path}/s"), flows.trip_feed(str(tmp_path), f"{tmp_path}/s", describe)
    for n in (0, 1, 1, 2, 3, 4):  # the second batch is run again after a failure
        batch = spark.createDataFrame([(v, at(m)) for v, m in batches[n]], "vehicle_id string, observed_at timestamp_ntz")
        outing(batch, n)
        publish(batch, n)
    zero = int((at(0) - at(0, "1970-01-01T00:00:00")).total_seconds() * 1000)
    got = sorted(collect(spark.read.parquet(f"{tmp_path}/feed"), "batch", "entity_id", "change"))
    assert got == sorted([
        (0, f"v:{zero + 9 * hour}", "new"), (1, f"v:{zero + 9 * hour}", "tombstone"), (1, f"v:{zero + 8 * hour + 1}", "new"), (2, f"w:{zero + 1}", "new"),
        (4, f"w:{zero + 1}", "tombstone"), (4, f"w:{zero}", "new"), (4, f"w:{zero + 99 * hour}", "new"),
    ])


def _stored_bytes(spark, df):
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in df.inputFiles() if "/days/" in f)


def test_a_batch_reads_the_days_it_touches_however_old_the_log_is(spark, tmp_path, monkeypatch):
    day, read = 86_400_000, []
    rows_of = flows._session_rows

    def watched(session, root, days=None):
        rows = rows_of(session, root, days)
        if days is not None:
            read.append(0 if rows is None else _stored_bytes(spark, rows))
        return rows

    monkeypatch.setattr(flows, "_session_rows", watched)
    step = flows.legs(str(tmp_path))
    for n in range(12):
        # Each day three vehicles drive, and the first sends something of the day before.
        rows = [(f"v{k}", at(n * day + k * 600_000 + i * 20_000)) for k in range(3) for i in range(5)] + [("v0", at((n - 1) * day + 7_000_000))] * (n > 0)
        step(spark.createDataFrame(rows, "vehicle_id string, observed_at timestamp_ntz"), n)
    assert max(read[6:]) <= max(read[2:6]) * 1.2 and max(read) > 0
    before = sorted(collect(flows.present(spark, str(tmp_path)), "vehicle_id", "started_at", "ended_at", "samples"))
    assert len(before) == 36 + 11
    some = spark.createDataFrame([("v0",)], "vehicle_id string")
    assert sorted(collect(flows.present(spark, str(tmp_path), some), "vehicle_id", "started_at", "ended_at", "samples")) == [r for r in before if r[0] == "v0"]


def test_compaction_leaves_the_sessions_as_they_are(spark, tmp_path):
    rows = [(f"v{k % 3}", at((k * k * 7919) % 3_000_000 + (k % 2) * 86_390_000)) for k in range(90)]
    schema = "vehicle_id string, observed_at timestamp_ntz"
    one, many = flows.legs(str(tmp_path / "one")), flows.legs(str(tmp_path / "many"))
    one(spark.createDataFrame(rows, schema), 0)
    for n in range(6):
        many(spark.createDataFrame(rows[n::6], schema), n)
        if n in (2, 4):
            for _ in range(2):
                flows.compact(spark, str(tmp_path / "many"), n)
    got = [sorted(collect(flows.present(spark, str(tmp_path / d)), "vehicle_id", "started_at", "ended_at", "samples")) for d in ("one", "many")]
    assert got[0] == got[1] and len(got[0]) > 10
    batches = {r.batch for r in spark.read.parquet(f"{tmp_path}/many/days").select("batch").distinct().collect()}
    assert batches <= {4, 5}


def test_a_session_over_midnight_is_found_from_either_day(spark, tmp_path):
    day, minute = 86_400_000, 60_000
    step = flows.outings(str(tmp_path))
    batches = [[("v", day - 50 * minute)], [("v", day - 1), ("v", day + 40 * minute)], [("v", 2 * day + 10 * minute)], [("v", 2 * day - 20 * minute)], [("v", day + 90 * minute)]]
    for n, rows in enumerate(batches):
        step(spark.createDataFrame([(v, at(m)) for v, m in rows], "vehicle_id string, observed_at timestamp_ntz"), n)
    got = sorted(collect(flows.present(spark, str(tmp_path)), "started_at", "ended_at", "samples"))
    assert got == [(at(day - 50 * minute), at(day + 90 * minute), 4), (at(2 * day - 20 * minute), at(2 * day + 10 * minute), 2)]


def test_sessions_take_late_vehicles_and_clocks_in_the_future(spark, tmp_path):
    hour = 3_600_000
    batches = [
        [("v", 0), ("v", hour), ("x", 999 * hour)],
        [("v", 9 * hour)],
        [("w", hour), ("w", hour + 5), (None, 3), ("v", None)],  # long after v's and x's samples
        [("v", 2 * hour + 7), ("v", -1)],  # joins nothing, and moves the first one's start
        [("v", 2 * hour)],  # joins two
    ]
    step = flows.outings(str(tmp_path))
    for n in (0, 1, 2, 2, 3, 4, 4):
        rows = [(v, None if m is None else at(m)) for v, m in batches[n]]
        step(spark.createDataFrame(rows, "vehicle_id string, observed_at timestamp_ntz"), n)
    got = sorted(collect(flows.present_outings(spark, str(tmp_path)), "vehicle_id", "started_at", "ended_at", "samples"))
    assert got == [
        ("v", at(-1), at(2 * hour + 7), 5), ("v", at(9 * hour), at(9 * hour), 1),
        ("w", at(hour), at(hour + 5), 2), ("x", at(999 * hour), at(999 * hour), 1),
    ]


def test_sessions_of_any_batches_are_those_of_all_rows(spark, tmp_path):
    rows = [(f"v{k % 3}", at((k * k * 7919) % 5_000_000)) for k in range(160)]
    everything = flows.legs(str(tmp_path / "one"))
    everything(spark.createDataFrame(rows, "vehicle_id string, observed_at timestamp_ntz"), 0)
    step = flows.legs(str(tmp_path / "many"))
    for n in range(4):
        step(spark.createDataFrame(rows[n::4], "vehicle_id string, observed_at timestamp_ntz"), n)
    one, many = (sorted(collect(flows.present(spark, str(tmp_path / d)), "vehicle_id", "started_at", "ended_at", "samples")) for d in ("one", "many"))
    assert one == many and len(one) > 20


def test_intake_batches_need_no_single_task(spark, monkeypatch):
    """Deliveries are dealt into three batches without a window over all of them."""
    from checks import stored

    seen = []
    monkeypatch.setattr(stored, "batch_by_batch", lambda rows, of_batch, step: seen.append(rows.select(of_batch.alias("b"))))
    with contextlib.suppress(Exception):  # nothing was taken in
        stored._taken_in(spark, "/root/testdata/sf0.001")
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    assert len({r["b"] for r in seen[0].distinct().collect()}) == 3


def test_a_batch_of_many_days_lists_them_in_few_folders(spark, tmp_path):
    day, schema = 86_400_000, "vehicle_id string, observed_at timestamp_ntz"
    step = flows.legs(str(tmp_path))
    for n in range(3):
        rows = [(f"v{d % 2}", at(d * day + n * 30_000)) for d in range(-300, 300)]
        step(spark.createDataFrame(rows, schema), n)
        folders = {f.parent for f in (tmp_path / "days").rglob(f"batch={n}/*.parquet")}
        assert 2 < len(folders) <= flows.FOLDERS
    step(spark.createDataFrame([("v0", at(298 * day - 1)), ("v0", at(-40_000 - 300 * day)), ("v1", at(9999 * day))], schema), 3)
    whole = [(f"v{d % 2}", at(d * day - (1 if d == 298 else 40_000 if d == -300 else 0)), at(d * day + 60_000), 4 if d in (298, -300) else 3) for d in range(-300, 300)]
    whole = sorted([*whole, ("v1", at(9999 * day), at(9999 * day), 1)])

    def found():
        return sorted(collect(flows.present(spark, str(tmp_path)), "vehicle_id", "started_at", "ended_at", "samples"))

    assert found() == whole
    # Days that share a block with others, and one that only a block of a single day holds.
    epoch = (at(0) - at(0, "1970-01-01T00:00:00")).days
    for upto, days in ((2, [epoch + 7]), (3, [epoch + 297]), (3, [epoch + 9999]), (3, [epoch + 5000])):
        flows.compact(spark, str(tmp_path), upto, days)
        assert found() == whole
    left = {r.batch for r in spark.read.parquet(f"{tmp_path}/days").where(f"day = {epoch + 7}").select("batch").collect()}
    assert left <= {2, 3}
    flows.compact(spark, str(tmp_path), 3)
    assert found() == whole and {r.batch for r in spark.read.parquet(f"{tmp_path}/days").select("batch").distinct().collect()} == {3}
