"""Sliced operators against brute force, with hot keys, edges and any number of partitions."""

from __future__ import annotations

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from odolake.operators import medians as medians_module
from odolake.operators import slices
from odolake.operators.asof import Side, asof, asof_join
from odolake.operators.medians import medians
from odolake.operators.spans import overlapping, points_in_spans
from odolake.plans import modules, synclog
from odolake.plans.registry import counter_verdicts, missing_counters
from odolake.plans.trips import v_trip_summary
from odolake.plans.trusted import v_position_trusted
from tests.conftest import at, collect, row


def stream(spark, n, seed, hot=0.6, span=400_000):
    """Rows of which one key holds most."""
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < hot else rng.choice("abc"), rng.randrange(span), i, rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, mono_ms bigint, seq bigint, x int")


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("within", [None, 3000])
def test_asof_equals_brute_force(spark, forward, within):
    left, ldf = stream(spark, 300, 1)
    right, rdf = stream(spark, 200, 2, span=100_000)
    side = Side("r", rdf, ["seq", "x"], forward=forward, within=within)
    got = {r.seq: (r.r.seq if r.r else None) for r in asof(ldf, [side], ["k"]).collect()}

    def best(k, ms):
        found = [r for r in right if r[0] == k and (r[1] >= ms if forward else r[1] <= ms)]
        if not found:
            return None
        nearest = (min if forward else max)(r[1] for r in found)
        if within is not None and abs(nearest - ms) > within:
            return None
        return max(r[2] for r in found if r[1] == nearest)

    assert got == {seq: best(k, ms) for k, ms, seq, _ in left}


def test_asof_two_sides_in_one_pass(spark):
    left, ldf = stream(spark, 100, 3)
    _, a = stream(spark, 100, 4)
    _, b = stream(spark, 100, 5)
    both = asof(ldf, [Side("a", a, ["seq"]), Side("b", b, ["seq"], forward=True)], ["k"])
    one = {r.seq: r.age_ms for r in asof_join(ldf, a, ["k"], ["x"]).collect()}
    two = {r.seq: r.age_ms for r in asof_join(ldf, b, ["k"], ["x"], forward=True).collect()}
    for r in both.collect():
        assert (r.mono_ms - r.a.mono_ms if r.a else None) == one[r.seq]
        assert (r.b.mono_ms - r.mono_ms if r.b else None) == two[r.seq]


def test_row_numbers_neighbours_and_running_equal_plain_windows(spark):
    _, df = stream(spark, 400, 6)
    w = Window.partitionBy("k").orderBy("mono_ms", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "seq", F.row_number().over(w).alias("n"), F.lag("seq").over(w).alias("p"), F.lead("seq").over(w).alias("f"),
        F.max("x").over(upto).alias("top"), F.sum("x").over(upto).alias("total"), F.last("x", True).over(upto).alias("latest"),
    )
    args = (["k"], ["mono_ms", "seq"], "mono_ms", 7000)
    out = slices.row_numbers(df, *args, "n")
    out = slices.neighbour(out, *args, ["seq"], "prev")
    out = slices.neighbour(out, *args, ["seq"], "next", following=True)
    aggs = {"top": ("max", F.col("x")), "total": ("sum", F.col("x")), "latest": ("last", F.col("x"))}
    out = slices.running(out, *args, aggs)
    got = out.select("seq", "n", F.col("prev.seq").alias("p"), F.col("next.seq").alias("f"), "top", "total", "latest")
    assert sorted(map(repr, collect(got, *want.columns))) == sorted(map(repr, collect(want, *want.columns)))


def test_points_and_overlaps_equal_brute_force(spark):
    rng = random.Random(8)
    pts, pdf = stream(spark, 200, 9)
    spans = [(rng.choice(["hot", "a", "b"]), s := rng.randrange(400_000), s + rng.randrange(90_000), i) for i in range(40)]
    sdf = spark.createDataFrame(spans, "k string, lo bigint, hi bigint, id bigint")
    got = collect(points_in_spans(pdf, "mono_ms", sdf, "lo", "hi", ["k"], 10_000), "seq", "id")
    assert sorted(got) == sorted((p[2], s[3]) for p in pts for s in spans if p[0] == s[0] and s[1] <= p[1] <= s[2])
    other = sdf.select("k", F.col("lo").alias("a"), F.col("hi").alias("b"), F.col("id").alias("id2"))
    got = collect(overlapping(sdf, ("lo", "hi"), other, ("a", "b"), ["k"], 10_000), "id", "id2")
    assert sorted(got) == sorted((x[3], y[3]) for x in spans for y in spans if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 7, 100, 101, 5000])
def test_medians_are_exact(spark, size):
    rng = random.Random(size)
    values = [rng.choice([rng.random(), rng.randrange(5)]) for _ in range(size)]
    df = spark.createDataFrame([("k", float(v)) for v in values] + [("k", None)], "k string, v double")
    got = collect(medians(df, ["k"], "v"), "median", "n")
    assert got == [(pytest.approx(statistics.median(values)), size)]


def test_medians_keep_groups_without_readings_and_null_keys(spark):
    rows = [("a", None), ("a", None), (None, 3.0), (None, 1.0), ("b", 2.0), ("b", None)]
    got = collect(medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), "k", "median", "n")
    assert sorted(got, key=str) == [("a", None, 0), ("b", 2.0, 1), (None, 2.0, 2)]
    assert medians(spark.createDataFrame([], "k string, v double"), ["k"], "v").count() == 0


@pytest.mark.parametrize("few", [0, 3])
def test_radix_selection_equals_sorting(spark, monkeypatch, few):
    """Every size of group through the selection: ties, signs, far apart exponents, neighbours that differ in the last bit."""
    monkeypatch.setattr(medians_module, "FEW", few)
    rng = random.Random(5)
    special = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, math.nextafter(1.0, 2.0), math.nextafter(1.0, 0.0)]
    groups = {}
    for g in range(24):
        pool = [*special[: g % 11], *(rng.choice([rng.gauss(0, 10 ** rng.randrange(-5, 6)), float(rng.randrange(4)), 1 + rng.randrange(9) * 2**-52]) for _ in range(g * 7 + 1))]
        groups[f"g{g}"] = [rng.choice(pool) for _ in range(len(pool) * 2 + g % 2)]
    rows = [(g, v) for g, values in groups.items() for v in values] + [("g3", None), ("none", None)]
    rng.shuffle(rows)
    got = {r[0]: r[1:] for r in collect(medians(spark.createDataFrame(rows, "k string, v double"), ["k"], "v"), "k", "median", "n")}
    want = {g: (statistics.median(v), len(v)) for g, v in groups.items()} | {"none": (None, 0)}
    assert got == want


def test_keys_order_doubles_and_tell_them_apart(spark):
    rng = random.Random(6)
    values = [math.ldexp(1 + rng.choice([0, 2**-52, 0.5, 1 - 2**-52, rng.random()]), e) for e in range(-1022, 1024)]
    values += [math.ldexp(rng.randrange(1, 1 << 52), -1074) for _ in range(200)] + [5e-324, 0.0, math.inf]
    values = sorted({*values, *(-v for v in values)}) + [math.nan]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    keys = [r[1] for r in sorted(df.select("i", medians_module.ordered_key("v")).collect())]
    assert all(a < b for a, b in zip(keys, keys[1:], strict=False))


def test_a_large_group_is_never_ranked_as_a_whole(spark):
    """Two million distinct values of one group: no step sees more than 65,536 rows for a rank, and parts stay even."""
    df = spark.range(2_000_001).select(F.lit("k").alias("k"), (F.xxhash64("id") / F.lit(1e12)).alias("v"))
    want = np.median(df.select("v").toPandas()["v"].to_numpy())
    seen = []
    count = medians_module.prefix_counts

    def watched(inside, left):
        held = inside.groupBy("_target", "_salt").count().agg(F.max("count"), F.sum("count")).first()
        seen.append((count(inside, left).groupBy("_k", "_target").count().agg(F.max("count")).first()[0], *held))
        return count(inside, left)

    try:
        medians_module.prefix_counts = watched
        got = collect(medians(df, ["k"], "v"), "median", "n")
    finally:
        medians_module.prefix_counts = count
    assert got == [(want, 2_000_001)]
    assert len(seen) == 4 and all(rows <= 65_536 for rows, _, _ in seen)
    assert seen[0][1] < 2.2 * seen[0][2] / medians_module.SALTS


def test_results_do_not_depend_on_the_number_of_partitions(spark, make):
    rng = random.Random(11)
    pos = [row(ms=700 * i, when=at(700 * i), lat=34 + i * 1e-5, lon=-118.0, fix_type=3, speed_mps=rng.random() * 30, sats_used=9) for i in range(600)]
    obd = [row(ms=300 * i, when=at(300 * i), speed_kph=rng.randrange(90), rpm=900) for i in range(900)]
    t = make(position=pos, obd=obd)
    found = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            verdicts = sorted(collect(v_position_trusted(t), "seq", "trusted"))
            summary = collect(v_trip_summary(t), "trip_id", "leg_count", "obd_samples", "fix_samples", F.round("distance_m", 6))
            found.append((verdicts, summary))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_counter_guard_cases(spark):
    offers = [("d", 3, "r3", 1), ("d", 1, "r1", 2), ("d", 3, "r3", 3), ("d", 3, "other", 4), ("d", 0, "z", 5), ("d", 7, "r7", 6)]
    df = spark.createDataFrame(offers, "device_id string, counter bigint, content_root string, arrival bigint")
    got = {r[0]: r[1:] for r in collect(counter_verdicts(df), "arrival", "verdict", "gap")}
    assert got == {1: ("new", 2), 2: ("new", 0), 3: ("duplicate", 0), 4: ("conflict", 0), 5: ("conflict", 0), 6: ("new", 3)}
    assert sorted(collect(missing_counters(df), "device_id", "counter")) == [("d", 2), ("d", 4), ("d", 5), ("d", 6)]


def judge(ops):
    by_id, by_key, out = {}, {}, {}
    for arrival, client, op, key, content in sorted(ops):
        if op in by_id:
            same = by_id[op] == (client, content)
            out[arrival] = "duplicate" if same else "reused_id"
        elif key and (client, key) in by_key:
            out[arrival] = "duplicate" if by_key[client, key] == content else "reused_key"
        else:
            out[arrival] = "accepted"
            by_id[op] = (client, content)
            if key:
                by_key[client, key] = content
    return out


def test_dedupe_equals_one_by_one(spark):
    rng = random.Random(3)
    ops = [(i, rng.choice("pq"), f"op{rng.randrange(40)}", rng.choice(["", f"k{rng.randrange(25)}"]), rng.choice("xy")) for i in range(300)]
    df = spark.createDataFrame(ops, "arrival bigint, client_id string, operation_id string, idem_key string, content_hash string")
    assert dict(collect(synclog.dedupe_operations(df), "arrival", "status")) == judge(ops)


def plain_intake(ops):
    """One by one, with everything that was accepted at hand."""
    ids, keys, revs, out = {}, {}, {}, {}
    for arrival, client, op, key, content, target, fields, base, refused, unfit in sorted(ops):
        slot = (client.lower(), key) if key else None
        if refused:
            out[arrival] = ("rejected", refused, None, None)
        elif op.lower() in ids:
            who, what, at, rev = ids[op.lower()]
            out[arrival] = ("duplicate", None, at, rev) if (who, what) == (client.lower(), content) else ("rejected", "reused_id", None, None)
        elif slot in keys:
            _, what, at, rev = keys[slot]
            out[arrival] = ("duplicate", None, at, rev) if what == content else ("rejected", "reused_key", None, None)
        elif unfit:
            out[arrival] = ("rejected", unfit, None, None)
        else:
            now = [revs.get((target, f), 0) for f in fields]
            if [b or 0 for b in base] != now:
                out[arrival] = ("conflict", None, None, now)
                continue
            after = [r + 1 for r in now]
            revs.update({(target, f): r for f, r in zip(fields, after, strict=True)})
            ids[op.lower()] = (client.lower(), content, arrival, after)
            if slot:
                keys[slot] = ids[op.lower()]
            out[arrival] = ("accepted", None, None, after)
    return out


OPERATIONS = "arrival bigint, client_id string, operation_id string, idem_key string, content_hash string, target string, fields array<string>, base array<bigint>, refused string, unfit string"


def decided(spark, ops):
    frame = spark.createDataFrame(ops, OPERATIONS).withColumns({"kind": F.lit("note"), "vehicle_id": F.lit("v")})
    return {r[0]: r[1:] for r in collect(synclog.intake(frame), "arrival", "status", "reason", "original", "revisions")}


def test_intake_is_one_decision(spark):
    def op(at, oid, base=0, key=None, content="c", fields=("title",), **more):
        return (at, "A", oid, key, content, "trip-1", list(fields), [base] * len(fields), more.get("refused"), more.get("unfit"))

    ops = [
        op(1, "u1"), op(2, "u1"), op(3, "U1", content="other"), op(4, "u2"),  # retry, reuse, stale
        op(5, "u2", 1),  # the refused conflict sent again under its id, on the revision it was told
        op(6, "u3", 2, key="k"), op(7, "u4", 9, key="k"), op(8, "u5", 3, key="k", content="x"),
        op(9, "u6", refused="out_of_scope"), op(10, "u6", 3), op(11, "u1", unfit="archived"), op(12, "u7", 4, unfit="archived"),
        op(13, "u7", 4, fields=("title", "tag")), op(14, "u8", None, fields=()),
    ]
    got = decided(spark, ops)
    assert got == plain_intake(ops)
    assert [got[i][0] for i in range(1, 15)] == [
        "accepted", "duplicate", "rejected", "conflict", "accepted", "accepted", "duplicate", "rejected", "rejected", "accepted", "duplicate", "rejected", "conflict", "accepted",
    ]
    assert decided(spark, []) == {}


def test_intake_equals_the_plain_walk_on_chains(spark):
    rng = random.Random(4)
    ops = []
    for at in range(600):
        fields = sorted(rng.sample(["a", "b", "c"], rng.randrange(0, 3)))
        ops.append((at, rng.choice("XxY"), f"op{rng.randrange(max(1, at - 4), at + 2)}", rng.choice([None, "", f"k{at // 3}"]), rng.choice("pq"), f"t{at // 40}", fields,
                    [rng.choice([None, 0, 1, 2]) for _ in fields], rng.choice([None] * 9 + ["early"]), rng.choice([None] * 9 + ["late"])))
    assert decided(spark, ops) == plain_intake(ops)


@pytest.mark.parametrize("order", ["up", "down", "mixed"])
def test_connected_groups_of_long_chains(spark, order, monkeypatch):
    from odolake.operators import groups

    rounds = []
    settle = groups.settle
    monkeypatch.setattr(groups, "settle", lambda df: rounds.append(1) or settle(df))
    n = 300
    names = list(range(n)) if order == "up" else list(range(n, 0, -1)) if order == "down" else random.Random(2).sample(range(10**12), n)
    links = [(names[i], names[i + 1]) for i in range(n - 1) if i % 100 != 99] + [(names[0], names[0]), (None, names[4]), (names[7], names[6])]
    got = dict(collect(groups.connected(spark.createDataFrame(links, "a bigint, b bigint")), "node", "root"))
    parts = [names[i : i + 100] for i in range(0, n, 100)]
    assert set(got) == set(names) and all(len({got[x] for x in part}) == 1 and got[part[0]] in part for part in parts)
    assert len({got[part[0]] for part in parts}) == 3 and len(rounds) < 45
    assert groups.connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_field_revisions_are_all_or_nothing(spark):
    ops = [("k", "v", "t", 1, ["a", "b"], [0, 0]), ("k", "v", "t", 2, ["a"], [0]), ("k", "v", "t", 3, ["a"], [1]),
           ("k", "v", "t", 4, ["a", "b"], [2, 0]), ("k", "v", "t", 5, ["a", "b"], [2, 1]), ("k", "v", "u", 6, ["a"], [None])]
    df = spark.createDataFrame(ops, "kind string, vehicle_id string, target string, arrival bigint, fields array<string>, base array<bigint>")
    got = {r[0]: r[1:] for r in collect(synclog.field_revisions(df), "arrival", "status", "revisions")}
    assert got == {1: ("accepted", [1, 1]), 2: ("conflict", [1]), 3: ("accepted", [2]), 4: ("conflict", [2, 1]), 5: ("accepted", [3, 2]), 6: ("accepted", [1])}


def test_change_feed_rekeys_with_a_tombstone(spark):
    def state(rows):
        return synclog.entity_state(spark.createDataFrame(rows, "id string, veh string, n int"), "trip", "id", "veh", ["n"])

    old = state([("v:1", "v", 1), ("v:9", "v", 1), ("v:7", "v", 1)])
    new = state([("v:0", "v", 2), ("v:9", "v", 1), ("v:7", "v", 5)])
    feed = synclog.change_feed(old, new)
    assert sorted(collect(feed, "entity_id", "change")) == [("v:0", "new"), ("v:1", "tombstone"), ("v:7", "changed")]
    after = synclog.next_state(old, feed)
    assert synclog.change_feed(after, new).count() == 0


def test_module_expressions_stay_in_their_row(make):
    cols = ["map_kpa", "baro_kpa"]
    assert modules.checked_expression("trunc(map_kpa / 3) + log(abs(baro_kpa))", cols) == "(sign(map_kpa / 3) * floor(abs(map_kpa / 3))) + log10(abs(baro_kpa))"
    for bad in ("(SELECT 1)", "rpm + 1", "map_kpa; DROP", "read_file(map_kpa)"):
        with pytest.raises(ValueError, match="derivation|not a column"):
            modules.checked_expression(bad, cols)
    assert modules.checked_expression("CASE WHEN map_kpa = 1 THEN 'select; from' END", cols)


def test_module_order_and_ownership():
    a = modules.Module("a", [modules.Derivation("boost.x", "double", "1")], requires=["boost.y"])
    b = modules.Module("b", [modules.Derivation("boost.y", "double", "1")])
    assert [m.id for m in modules.in_order([a, b])] == ["b", "a"]
    with pytest.raises(ValueError, match="wait for each other"):
        modules.in_order([a, modules.Module("b", b.derives, requires=["boost.x"])])
    with pytest.raises(ValueError, match="owner"):
        modules.metric_keys([modules.Module("m", metrics=[modules.Metric("lambda", "v", "c", "pull")])])
