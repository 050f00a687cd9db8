"""Repairs against known cases and against plain Python."""

from __future__ import annotations

import datetime as dt
import random

import pyarrow as pa
import pytest

from odolake.functions.geo import metres
from odolake.plans import repair, trips
from odolake.sources.dimensions import parse_corrections
from tests.conftest import collect, row

BASIS = 1_790_000_000_000


def stamp(basis, ms):
    return dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=basis + ms)


def bundle_rows(boot, root, lo, hi, basis):
    return [row("v1", boot, 1000 * s, when=stamp(basis, 1000 * s), root=root, speed_kph=40) for s in range(lo, hi + 1)]


def undated_case(make):
    spans = [("A", "a1", 600, 660, BASIS), ("A", "a2", 661, 700, 0), ("A", "a3", 701, 760, BASIS + 40), ("A", "a4", 5000, 5010, 0),
             ("B", "b1", 100, 110, 0), ("C", "c1", 100, 110, BASIS), ("C", "c2", 111, 120, 0), ("C", "c3", 121, 130, BASIS + 60_000),
             ("D", "d0", 100, 120, BASIS + 86_400_000), ("D", "d1", 125, 130, 0), ("D", "d2", 400, 430, BASIS), ("D", "d3", 431, 460, 0),
             ("D", "d4", 461, 490, BASIS), ("D", "d5", 491, 500, 0), ("D", "d6", 501, 520, BASIS)]
    status = [row("v1", "D", 1000 * i, when=stamp(BASIS + 86_400_000, 1000 * i), root="d0") for i in range(100, 600)]
    gap = [{"vehicle_id": "v1", "content_root": "a2", "boot_id": "A", "seq": 1, "started_at": stamp(0, 670_000), "duration_ms": 5000}]
    return make(obd=[r for s in spans for r in bundle_rows(*s)], status=status, gap=gap)


def test_undated_bundles_are_dated_only_between_agreeing_ones(make):
    t = undated_case(make)
    assert dict(collect(repair.basis_repairs(t), "content_root", "basis_ms")) == {"a2": BASIS + 20, "d3": BASIS, "d5": BASIS}
    fixed = repair.date_undated(t)
    (when,) = collect(fixed.obd.where("content_root = 'a2' AND mono_ms = 661000"), "observed_at")[0]
    assert when == stamp(BASIS + 20, 661_000)
    assert collect(fixed.gap, "started_at") == [(stamp(BASIS + 20, 670_000),)]
    dated = trips.v_trip_summary(fixed).where("started_at >= TIMESTAMP_NTZ '2000-01-01' AND duration_ms >= 150000")
    assert dated.count() == 1


def test_mixed_boot_goes_to_the_last_car(make):
    bundles = [{"content_root": r, "vehicle_id": v, "device_id": "d", "boot_id": b} for r, v, b in (("r1", "x", "A"), ("r2", "y", "A"), ("r3", "x", "B"))]
    obd = [row("x", "A", 1, root="r1"), row("y", "A", 900, root="r2"), row("x", "B", 5, root="r3")]
    fixed = repair.file_mixed_boots(make(bundles=bundles, obd=obd))
    assert sorted(collect(fixed.bundles, "content_root", "vehicle_id")) == [("r1", "y"), ("r2", "y"), ("r3", "x")]
    assert sorted(collect(fixed.obd, "content_root", "vehicle_id")) == [("r1", "y"), ("r2", "y"), ("r3", "x")]


def test_corrections_apply_in_order_and_only_to_rows_that_claim_the_car(make):
    bundles = [{"content_root": "r1", "vehicle_id": "a", "device_id": "d", "boot_id": "A"}, {"content_root": "r2", "vehicle_id": "a", "device_id": "other", "boot_id": "A"}]
    obd = [row("a", "A", 1, root="r1"), row("z", "A", 2, root="r1"), row("a", "A", 3, root="r2")]
    cs = [repair.Correction("d", ["A"], "a", "b", "x"), repair.Correction("d", ["A"], "b", "c", "y")]
    t = make(bundles=bundles, obd=obd)
    fixed = repair.apply_corrections(t, cs)
    assert sorted(collect(fixed.obd, "mono_ms", "vehicle_id")) == [(1, "c"), (2, "z"), (3, "a")]
    assert sorted(collect(repair.correction_counts(t.bundles, cs), "correction", "bundles")) == [(0, 1), (1, 1)]


ID = "ab" * 16


@pytest.mark.parametrize(
    "change",
    [{"device_id": "short"}, {"to_vehicle_id": ID}, {"boot_ids": []}, {"reason": " "}, {"extra": 1}, {"boot_ids": ["zz"]}],
)
def test_a_correction_that_does_not_check_is_refused(change):
    good = {"device_id": ID, "boot_ids": [ID], "from_vehicle_id": ID, "to_vehicle_id": "cd" * 16, "reason": "lent"}
    assert len(parse_corrections({"corrections": [good]})) == 1
    with pytest.raises(ValueError, match="correction 1"):
        parse_corrections({"corrections": [{**good, **change}]})


def walk(fixes, gaps):
    """The rule as it reads, one bundle at a time."""
    kept, passed, rejects = [], [], 0
    for seq, ms, lat, lon in fixes:
        if lat is None or lon is None:
            passed.append((seq, ms, lat, lon))
            continue
        if kept:
            p = kept[-1]
            far = metres(p[2], p[3], lat, lon) > 50 + 40 * max((ms - p[1]) / 1000, 1)
            if far and not any(p[0] < g < seq for g in gaps) and rejects < 5:
                rejects += 1
                continue
        rejects = 0
        kept.append((seq, ms, lat, lon))
    return sorted(kept + passed, key=lambda f: f[0])


def gate(make, bundles):
    pos, gap = [], []
    for root, (fixes, gaps) in bundles.items():
        pos += [row(ms=ms, seq=seq, root=root, lat=lat, lon=lon) for seq, ms, lat, lon in fixes]
        gap += [{"vehicle_id": "v", "content_root": root, "boot_id": "A", "seq": g} for g in gaps]
    t = make(position=pos, gap=gap)
    got = {}
    for root, seq in collect(repair.jump_gate(t.position, t.gap), "content_root", "seq"):
        got.setdefault(root, []).append(seq)
    return {k: sorted(v) for k, v in got.items()}


def test_jump_gate_cases(make):
    burst = [(1, 3046729, 33.9775, -118.4159), (2, 3047940, 33.9774, -118.4152), (3, 3099502, 33.9584, -118.4015),
             (4, 3099693, 33.9583, -118.4015), (5, 3101289, 33.9570, -118.4017), (6, 5212183, 33.9784, -118.4159)]
    steady = [(i, 1000 * i, 34.0 + i * 30 / 110540, -118.4) for i in range(60)]
    bad_first = [(0, 0, 33.0, -117.0)] + [(i, 1000 * i, 34.0, -118.4) for i in range(1, 21)]
    leap = [(1, 1000, 34.0, -118.4), (3, 3000, 34.05, -118.35)]
    got = gate(make, {"burst": (burst, []), "steady": (steady, []), "bad": (bad_first, []), "leap": (leap, []), "gap": (leap, [2])})
    assert {k: len(v) for k, v in got.items()} == {"burst": 3, "steady": 60, "bad": 16, "leap": 1, "gap": 2}


def test_jump_gate_equals_the_plain_walk_on_random_paths(make):
    rng = random.Random(7)
    bundles = {}
    for b in range(6):
        lat, fixes, seq = 34.0, [], 0
        for i in range(400):
            seq += rng.randint(1, 3)
            jump = rng.random() < (0.05 + 0.15 * b)
            fixes.append((seq, 1000 * i, lat + (rng.choice([0.05, 0.1, -0.2]) if jump else 0), -118.0))
            lat += 0.0001
        bundles[f"b{b}"] = (fixes, sorted(rng.sample(range(seq), 5)))
    want = {k: [f[0] for f in walk(*v)] for k, v in bundles.items()}
    assert gate(make, bundles) == want


def test_a_fix_without_coordinates_passes_and_is_no_measure(make):
    fixes = [(i, 1000 * i, None if i == 5 else 34.0 + i * 1e-4, -118.4 if i != 8 else None) for i in range(12)]
    assert gate(make, {"a": (fixes, [])}) == {"a": list(range(12))}
    # The jump after it is measured from the fix before it.
    assert gate(make, {"a": ([*fixes[:6], (6, 6000, 35.0, -118.4)], [])}) == {"a": list(range(6))}


@pytest.mark.parametrize("width", [8, 64])
def test_jump_gate_without_a_calm_fix_is_decided_slice_by_slice(make, monkeypatch, width):
    """Bundles that scatter from end to end, so that every slice is entered in some state that only its neighbour knows."""
    monkeypatch.setattr(repair, "GATE_SLICE", width)
    rng = random.Random(width)
    bundles = {}
    for b in range(5):
        fixes = [(3 * i, 1000 * i, 34.0 + rng.choice([0, 0.01, 0.5, 0.9][: 2 + b % 3]) * rng.random(), -118.0) for i in range(600)]
        if b == 3:
            fixes = [(s, ms, None if s % 7 == 0 else lat, lon) for s, ms, lat, lon in fixes]
        bundles[f"b{b}"] = (fixes, sorted(rng.sample(range(1800), 9)))
    want = {k: [f[0] for f in walk(*v)] for k, v in bundles.items()}
    assert any(len(v) < 400 for v in want.values())
    assert gate(make, bundles) == want


def test_a_stretch_without_calm_fixes_spreads_over_slices(make, monkeypatch):
    monkeypatch.setattr(repair, "GATE_SLICE", 32)
    fixes = [(i, 1000 * i, 34.0 + (i % 2) * 0.5, -118.0) for i in range(400)]
    rows = [row(ms=ms, seq=seq, root="r", lat=lat, lon=lon) for seq, ms, lat, lon in fixes]
    t = make(position=rows)
    assert sorted(r[0] for r in collect(repair.jump_gate(t.position, t.gap), "seq")) == [f[0] for f in walk(fixes, [])]
    # A slice of the middle, with nothing known of what is before it: its map holds for every entry state.
    part = pa.table({"_pos": list(range(64, 96)), "_reached": [0b01010] * 32})
    seen = repair._judge_slice(part, 32)
    for state in range(6):
        r = state
        for keeps, after in zip(seen["_keeps"].to_pylist(), seen["_after"].to_pylist(), strict=True):
            r = 0 if r == 5 or 0b01010 >> r & 1 else r + 1
            assert (keeps >> state & 1 == 1) == (r == 0) and after >> 3 * state & 7 == r


def test_chain_stops_at_the_first_break(spark):
    rows = [("good", i, i, i + 10, i + 9 if i else 0) for i in range(5)]
    rows += [("cut", i, i, i + 10, (99 if i == 3 else i + 9) if i else 0) for i in range(5)]
    rows += [("skip", i, i + (i > 2), i + 10, i + 9 if i else 0) for i in range(5)]
    frames = spark.createDataFrame(rows, "content_root string, pos bigint, seq bigint, crc bigint, prev_crc bigint")
    got = {r[0]: r[1:] for r in collect(repair.chain_report(frames), "content_root", "kept", "discarded", "reason")}
    assert got == {"good": (5, 0, "eof"), "cut": (3, 2, "chain_break"), "skip": (3, 2, "seq_gap")}


def test_digest_tells_values_apart_that_look_alike(spark):
    def digest(*values):
        rows = spark.createDataFrame([("r", *values)], "content_root string, a string, b string")
        return collect(repair.bundle_digests({"t": rows}, {"t": ["a", "b"]}), "output_digest")[0]

    alike = [("a|b", "c"), ("a", "b|c"), ("~", None), (None, "~"), ("-", None), ("", None), (None, ""), ("1:a", ""), ("", "1:a"), ("0:", "a"), ("a", "0:"), (None, None)]
    assert len({digest(*v) for v in alike}) == len(alike)


def test_digest_ignores_order_and_sees_any_change(make):
    rows = [row(ms=i, root="r", rpm=i) for i in range(50)]
    cols = {"obd": ["seq", "rpm"]}

    def digest(given):
        return collect(repair.bundle_digests(make(obd=given), cols), "output_digest")

    assert digest(rows) == digest(rows[::-1])
    assert digest(rows) != digest([*rows[:-1], {**rows[-1], "rpm": 7}])
    assert digest(rows) != digest([*rows[:-1], {**rows[-1], "rpm": None}])


def test_digests_hash_all_columns_of_all_tables(spark):
    from checks import repairs, testbed

    tables = testbed.telemetry(spark, "/root/testdata/sf0.001")
    want = {n: set(tables[n].columns) for n in [*testbed.FROM_TICKS, "wifi_ap_obs"]}
    assert {n: set(cols) for n, cols in repairs.HASHED.items()} == want
    assert {"position", "boost", "gap", "transition"} <= set(want)
