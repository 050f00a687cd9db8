"""The batch load: repeats, breaks and replaced bundles."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from odolake.plans import bundle, load
from tests.conftest import at, collect, row

DAY = 86_400_000


def bundles(*roots):
    return [{"content_root": r, "vehicle_id": "v", "device_id": "d", "boot_id": "A"} for r in roots]


def drive(root, start, speed, n=60, step=1e-4):
    """Fixes and engine polls of a bundle, a second apart."""
    fixes = [row(ms=1000 * i, seq=2 * i, when=at(start + 1000 * i), root=root, lat=34.0 + step * i, lon=-118.0, fix_type=3, speed_mps=speed) for i in range(n)]
    polls = [row(ms=1000 * i, seq=2 * i + 1, when=at(start + 1000 * i), root=root, speed_kph=int(speed * 3.6), rpm=1500) for i in range(n)]
    return fixes, polls


def tables(make, *drives):
    fixes, polls = [sum((d[i] for d in drives), []) for i in (0, 1)]
    roots = dict.fromkeys(f["content_root"] for f in fixes)
    gaps = [{"vehicle_id": "v", "content_root": r, "boot_id": "A", "seq": 999, "started_at": at(5000), "duration_ms": 12_000, "cause": 1} for r in roots]
    return make(position=fixes, obd=polls, gap=gaps, bundles=bundles(*roots))


def whole(t):
    """What one computation over everything gives."""
    trips = bundle.bundle_trips(t)
    events = bundle.bundle_events(t, trips).join(t.bundles.select("content_root", "device_id"), "content_root")
    return days(bundle.daily_rollups(trips, events))


def days(rollups):
    cols = ["day", "trip_count", F.round("distance_m", 6), "duration_s", "max_speed_mps", "gap_duration_s", "event_count"]
    return sorted(collect(rollups, *cols), key=repr)


def seen(spark, root):
    return {n: sorted(collect(load.loaded(spark, root, n).select("content_root", F.xxhash64(F.to_json(F.struct("*")))), "*"), key=repr) for n in ("position", "obd", "trips", "events", "runs")}


def test_replaced_bundles_leave_what_one_load_leaves(spark, make, tmp_path):
    a, b, c = drive("a", 0, 20.0), drive("b", 3_600_000, 12.0), drive("c", DAY, 8.0)
    root = str(tmp_path)
    load.load_bundles(tables(make, a, b), root, 0)
    assert days(load.rollups(spark, root)) == whole(tables(make, a, b))
    load.load_bundles(tables(make, c), root, 1)
    # The bundle with the top speed comes again, slower; the other one's speed is the top now.
    slow = drive("a", 0, 5.0, n=30)
    load.load_bundles(tables(make, slow), root, 2)
    assert days(load.rollups(spark, root)) == whole(tables(make, slow, b, c))
    # Another moves to the next day, and its day is left to the first alone.
    late = drive("b", DAY + 7_200_000, 12.0)
    load.load_bundles(tables(make, late), root, 3)
    assert days(load.rollups(spark, root)) == whole(tables(make, slow, late, c))
    one = str(tmp_path / "one")
    load.load_bundles(tables(make, slow, late, c), one, 0)
    assert seen(spark, root) == seen(spark, one)
    assert load.loaded(spark, root, "trips").count() == 3 and load.loaded(spark, root, "obd").count() == 30 + 60 + 60
    # The last version of a bundle may be without rows.
    load.load_bundles(make(bundles=bundles("c")), root, 4)
    assert load.loaded(spark, root, "trips").where("content_root = 'c'").count() == 0
    assert days(load.rollups(spark, root)) == whole(tables(make, slow, late))


def test_loading_twice_is_loading_once(spark, make, tmp_path):
    t = tables(make, drive("a", 0, 20.0), drive("b", 3_600_000, 12.0))
    load.load_bundles(t, str(tmp_path), 0)
    once, first = seen(spark, str(tmp_path)), days(load.rollups(spark, str(tmp_path)))
    load.load_bundles(t, str(tmp_path), 1)
    assert seen(spark, str(tmp_path)) == once and days(load.rollups(spark, str(tmp_path))) == first


@pytest.mark.parametrize("broken", ["trips", "commits"])
def test_a_batch_that_breaks_off_is_not_seen_and_is_made_good(spark, make, tmp_path, monkeypatch, broken):
    root = str(tmp_path)
    load.load_bundles(tables(make, drive("a", 0, 20.0)), root, 0)
    before, first = seen(spark, root), days(load.rollups(spark, root))
    write = load._write

    def failing(rows, path, name, batch):
        if name == broken:
            raise RuntimeError("lost")
        write(rows, path, name, batch)

    again = tables(make, drive("a", 0, 3.0), drive("b", DAY, 9.0))
    monkeypatch.setattr(load, "_write", failing)
    with pytest.raises(RuntimeError, match="lost"):
        load.load_bundles(again, root, 1)
    assert seen(spark, root) == before and days(load.rollups(spark, root)) == first
    monkeypatch.setattr(load, "_write", write)
    load.load_bundles(again, root, 1)
    assert days(load.rollups(spark, root)) == whole(again) and load.loaded(spark, root, "trips").count() == 2


def test_nothing_loaded_and_impossible_fixes(spark, make, tmp_path):
    assert load.loaded(spark, str(tmp_path), "trips") is None and load.rollups(spark, str(tmp_path)) is None
    fixes, polls = drive("a", 0, 10.0)
    fixes[30]["lat"] = 40.0
    load.load_bundles(tables(make, (fixes, polls)), str(tmp_path), 0)
    assert load.loaded(spark, str(tmp_path), "position").count() == 59
    assert load.loaded(spark, str(tmp_path), "trips").first().distance_m < 700
