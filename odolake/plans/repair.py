"""Repairs made before any view reads the tables, and the checks that show what is wrong."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odolake.functions.flags import BOOT
from odolake.functions.geo import great_circle_sql
from odolake.functions.timecols import millis
from odolake.operators.asof import Side, asof
from odolake.operators.medians import medians
from odolake.operators.slices import SLICE, neighbour, row_numbers, slice_of, with_edge_copies
from odolake.operators.spans import overlapping
from odolake.schemas import COUNTED_TABLES, TIME_COLUMN, VEHICLE_TABLES
from odolake.session import settle
from odolake.sources.tables import Tables

ROOT = ["content_root"]
SEQ_SLICE = 65_536

# --- vehicle filing ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Correction:
    """The boots of one device that were recorded under the wrong vehicle."""

    device_id: str
    boot_ids: Sequence[str]
    from_vehicle_id: str
    to_vehicle_id: str
    reason: str


def _resolved(spark: SparkSession, corrections: Sequence[Correction]) -> DataFrame:
    """Declarations as a table: device, boot and claimed vehicle, the vehicle it ends at, and the corrections on the way.

    A vehicle that a correction files elsewhere meets the later ones under its new name, so each claim is followed
    through the later declarations of its device and boot. There are as many claims as declared boots.
    """
    of_boot: dict[tuple[str, str], list[tuple[int, str, str]]] = {}
    for n, c in enumerate(corrections):
        for boot in dict.fromkeys(c.boot_ids):
            of_boot.setdefault((c.device_id, boot), []).append((n, c.from_vehicle_id, c.to_vehicle_id))
    rows = []
    for (device, boot), steps in of_boot.items():
        # From the last to the first: where a claim ends follows from where its successor does.
        ends: dict[str, tuple[str, list[int]]] = {}
        for n, start, to in reversed(steps):
            end, way = ends.get(to, (to, []))
            ends[start] = (end, [n, *way])
        rows += [(device, boot, start, end, way) for start, (end, way) in ends.items()]
    return spark.createDataFrame(
        rows, "device_id string, boot_id string, old_vehicle string, new_vehicle string, way array<int>"
    )


def _claims(bundles: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    declared = _resolved(bundles.sparkSession, corrections)
    rows = bundles.select("content_root", "device_id", "boot_id", F.col("vehicle_id").alias("old_vehicle"))
    return rows.join(declared, ["device_id", "boot_id", "old_vehicle"])


def correction_moves(bundles: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    """content_root, old and new vehicle of every bundle the corrections move, applied in order."""
    moved = _claims(bundles, corrections).select("content_root", "old_vehicle", "new_vehicle")
    return moved.where("old_vehicle <> new_vehicle")


def correction_counts(bundles: DataFrame, corrections: Sequence[Correction]) -> DataFrame:
    """How many bundles each correction files elsewhere."""
    each = _claims(bundles, corrections).select(F.explode("way").alias("correction"))
    return each.groupBy("correction").agg(F.count(F.lit(1)).alias("bundles"))


def refile(table: DataFrame, moves: DataFrame, any_vehicle: bool = False) -> DataFrame:
    """Rows of moved bundles get the new vehicle; by default only those that claim the old one."""
    joined = table.join(moves, ROOT, "left")
    ours = F.col("new_vehicle").isNotNull()
    if not any_vehicle:
        ours = ours & (F.col("vehicle_id") == F.col("old_vehicle"))
    vehicle = F.when(ours, F.col("new_vehicle")).otherwise(F.col("vehicle_id"))
    return joined.select(*[vehicle.alias(c) if c == "vehicle_id" else F.col(c) for c in table.columns])


def apply_corrections(t: Tables, corrections: Sequence[Correction]) -> Tables:
    moves = correction_moves(t.bundles, corrections)
    return t.replace(**{n: refile(t[n], moves) for n in VEHICLE_TABLES if n in t})


def mixed_boot_moves(t: Tables) -> DataFrame:
    """Bundles of boots that name several vehicles, filed under the vehicle of the boot's last bundle."""
    boots = ["device_id", "boot_id"]
    b = t.bundles.select("content_root", *boots, "vehicle_id").where("device_id IS NOT NULL AND boot_id IS NOT NULL")
    mixed = b.groupBy(*boots).agg(F.count_distinct("vehicle_id").alias("n")).where("n > 1").select(*boots)
    inside = settle(b.join(mixed, boots))
    seen = [t[n].select("content_root", "mono_ms") for n in ("status", "transition", "obd", "imu", "position")]
    roots = inside.select("content_root")
    ends = reduce(DataFrame.unionByName, seen).join(roots, ROOT, "left_semi").groupBy(*ROOT).agg(F.max("mono_ms").alias("hi"))
    last = (
        inside.join(ends, ROOT)
        .groupBy(*boots)
        .agg(F.max_by("vehicle_id", F.struct("hi", "content_root")).alias("new_vehicle"))
    )
    return inside.join(last, boots).where("vehicle_id <> new_vehicle").select("content_root", "new_vehicle")


def file_mixed_boots(t: Tables) -> Tables:
    moves = mixed_boot_moves(t)
    return t.replace(**{n: refile(t[n], moves, any_vehicle=True) for n in VEHICLE_TABLES if n in t})


# --- dating bundles without a clock -----------------------------------------------------------

AGREE_MS = 5000
REACH_MS = 600_000
CLOCK_SET = "TIMESTAMP_NTZ '2000-01-01 00:00:00'"


def basis_spans(t: Tables) -> DataFrame:
    """Clock span of each bundle, whether it is undated, and the clock basis its rows imply: the median of wall clock less mono_ms."""
    own = ["content_root", *BOOT]
    sampled = []
    for name in ("position", "obd", "imu", "boost", "status", "transition"):
        # A fix carries the receiver's time, so it says nothing of the device's; a state says nothing of driving.
        says = F.lit(name != "position"), F.lit(name not in ("status", "transition"))
        sampled.append(t[name].select(F.struct(*own).alias("_k"), "mono_ms", "observed_at", says[0].alias("_clocked"), says[1].alias("_driven")))
    rows = reduce(DataFrame.unionByName, sampled).where("_k.content_root IS NOT NULL AND _k.boot_id IS NOT NULL")
    rows = rows.withColumn("_set", F.expr(f"coalesce(observed_at >= {CLOCK_SET}, false)"))
    driven = F.when(F.col("_driven"), F.col("mono_ms"))
    spans = rows.groupBy("_k").agg(
        F.min("mono_ms").alias("lo"), F.max("mono_ms").alias("hi"), F.min(driven).alias("s_lo"), F.max(driven).alias("s_hi"),
        (~F.bool_or("_set")).alias("undated"),
    )
    implied = rows.where("_clocked AND _set").withColumn("_basis", millis("observed_at") - F.col("mono_ms"))
    clocks = medians(implied, ["_k"], "_basis", "basis_ms", "_readings").drop("_readings")
    return spans.join(clocks, "_k", "left").select("_k.*", "lo", "hi", "s_lo", "s_hi", "undated", "basis_ms")


def _settled_clocks(dated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated bundles with their verdict on the boot's clock, and the boots whose clock enough of them share.

    The boot's clock is the median of its bundles'; a bundle agrees within 5 s of it. It takes two that agree, and
    two thirds of all.
    """
    middle = medians(dated, BOOT, "basis_ms", "_middle", "_bundles").select(*BOOT, F.bround("_middle").cast("long").alias("boot_basis"))
    judged = dated.join(middle, BOOT).withColumn("agrees", F.abs(F.col("basis_ms") - F.col("boot_basis")) <= AGREE_MS)
    vote = F.sum(F.when(F.col("agrees"), 1).otherwise(-2))
    sure = F.when(F.col("agrees"), F.col("lo")), F.when(F.col("agrees"), F.col("hi"))
    boots = judged.groupBy(*BOOT, "boot_basis").agg(
        F.min(sure[0]).alias("first_lo"), F.max(sure[1]).alias("last_hi"), F.count_if("agrees").alias("_agreeing"), vote.alias("_vote")
    )
    # Two thirds agree where each that doesn't is outweighed by two that do.
    return judged, boots.where("_agreeing >= 2 AND _vote >= 0").drop("_agreeing", "_vote")


def basis_repairs(t: Tables) -> DataFrame:
    """Undated bundles that the agreeing bundles of their boot can date: content_root, basis_ms.

    An undated bundle must lie between agreeing ones, or within ten minutes outside of them, and no disagreeing bundle
    may have driven in the stretch from the agreeing one before it (ten minutes before it where there is none) to the
    one after it.
    """
    spans = settle(basis_spans(t))
    judged, boots = _settled_clocks(spans.where("NOT undated AND basis_ms IS NOT NULL"))
    judged = settle(judged)
    sure = judged.where("agrees").withColumn("seq", F.lit(0).cast("long"))
    undated = spans.where("undated").select("content_root", *BOOT, "lo", "hi").join(boots, BOOT)
    for name, own, theirs, forward in (("_before", "lo", "hi", False), ("_after", "hi", "lo", True)):
        marks = sure.select(*BOOT, "seq", F.col(theirs).alias("_at"))
        undated = asof(undated.withColumn("_at", F.col(own)), [Side(name, marks, [], forward=forward)], BOOT, on="_at", width=REACH_MS)
    near = "(_before IS NOT NULL OR first_lo - lo <= {0}) AND (_after IS NOT NULL OR hi - last_hi <= {0})".format(REACH_MS)
    held = settle(
        undated.where(near).select(
            *BOOT, "content_root", F.col("boot_basis").alias("basis_ms"),
            F.expr(f"coalesce(_before._at, lo - {REACH_MS})").alias("_from"), F.expr(f"coalesce(_after._at, hi + {REACH_MS})").alias("_to"),
        )
    )
    against = judged.where("NOT agrees").select(*BOOT, F.coalesce("s_lo", "lo").alias("_lo"), F.coalesce("s_hi", "hi").alias("_hi"))
    spoiled = overlapping(held, ("_from", "_to"), against, ("_lo", "_hi"), BOOT, REACH_MS).select("content_root")
    return held.join(spoiled, ROOT, "left_anti").select("content_root", "basis_ms")


def date_rows(table: DataFrame, repairs: DataFrame, column: str) -> DataFrame:
    """Shift the wall-clock column of repaired bundles by their boot's basis."""
    joined = table.join(repairs, ROOT, "left")
    micros = F.unix_micros(F.col(column).cast("timestamp")) + F.col("basis_ms") * 1000
    shifted = F.when(F.col("basis_ms").isNotNull(), F.timestamp_micros(micros).cast("timestamp_ntz")).otherwise(
        F.col(column)
    )
    return joined.select(*[shifted.alias(c) if c == column else F.col(c) for c in table.columns])


def date_undated(t: Tables) -> Tables:
    repairs = settle(basis_repairs(t))
    return t.replace(**{n: date_rows(t[n], repairs, c) for n, c in TIME_COLUMN.items() if n in t})


# --- values -----------------------------------------------------------------------------------


def clear_unavailable_speed(obd: DataFrame) -> DataFrame:
    """255 km/h at 0 rpm is an engine controller saying "not available"."""
    absent = (F.col("speed_kph") == 255) & (F.col("rpm") == 0)
    return obd.withColumn("speed_kph", F.when(F.coalesce(absent, F.lit(False)), None).otherwise(F.col("speed_kph")))


# --- impossible jumps -------------------------------------------------------------------------

JUMP_SLACK_M = 50.0
JUMP_MPS = 40.0
MAX_REJECTS = 5
GATE_SLICE = 4096
#: The states of the gate: how many fixes it has refused since the last kept one.
_STATES = MAX_REJECTS + 1
_ALWAYS = (1 << _STATES) - 1


def jump_gate(positions: DataFrame, gaps: DataFrame) -> DataFrame:
    """Drop fixes that lie too far from the last kept fix of their bundle.

    Which fix was kept last depends on every earlier decision, but no more than five in a row are refused, so it is one of
    the six before, and the gate's state is the number refused since: a fix turns each state r into 0 (kept) or r + 1. A fix in
    reach of the five before it turns all states into 0; the others are decided slice by slice for every state the slice may
    be entered in, by composing their maps. What a slice makes of its entry state is one small map, which passes along
    the bundle from slice to slice; only then the fixes whose fate depends on it are settled. No stretch, however long,
    is walked as a whole.

    A fix without coordinates has no distance to anything: it passes and is never the last kept fix.
    """
    width = GATE_SLICE
    placed = "lat IS NOT NULL AND lon IS NOT NULL"
    rows = row_numbers(positions.where(placed), ROOT, ["seq"], "seq", SEQ_SLICE, "_pos")
    # The last gap strictly before the fix.
    rows = rows.withColumn("_at", F.col("seq") - 1)
    gap_rows = gaps.select(*ROOT, "seq", F.col("seq").alias("_at"))
    rows = asof(rows, [Side("_gap", gap_rows, ["seq"])], ROOT, on="_at", width=SEQ_SLICE)
    rows = rows.withColumn("_gap_seq", F.col("_gap.seq")).drop("_gap", "_at")
    near = with_edge_copies(rows, "_pos", width, after=MAX_REJECTS)
    along = Window.partitionBy(*ROOT, SLICE).orderBy("_pos")
    place = F.struct("lat", "lon", "mono_ms", "seq")
    near = near.withColumns({f"_b{i}": F.lag(place, i).over(along) for i in range(1, _STATES)})
    reached = " + ".join(f"CASE WHEN {_in_reach(f'_b{i}')} THEN {1 << (i - 1)} ELSE 0 END" for i in range(1, _STATES))
    own = near.where(F.col(SLICE) == slice_of("_pos", width))
    own = settle(own.select(*positions.columns, "_pos", F.col(SLICE).cast("long").alias("_part"), F.expr(reached).alias("_reached")))

    calm = F.col("_reached") == (1 << MAX_REJECTS) - 1
    schema = T.StructType([*own.schema, T.StructField("_keeps", T.IntegerType()), T.StructField("_after", T.IntegerType())])
    judged = settle(own.where(~calm).groupBy(*ROOT, "_part").applyInArrow(lambda rows: _judge_slice(rows, width), schema))
    exits = judged.where(F.col("_pos") % width == width - 1).select(*ROOT, "_part", "_after")
    ordered = exits.repartition(*ROOT).sortWithinPartitions(*ROOT, "_part")
    entries = ordered.mapInPandas(_pass_on, "content_root string, _part bigint, _entry int")
    open_ = judged.where(F.col("_keeps").between(1, _ALWAYS - 1)).join(entries, [*ROOT, "_part"], "left")
    settled = open_.where(F.expr("shiftright(_keeps, coalesce(_entry, 0)) & 1 = 1"))
    parts = (own.where(calm), judged.where(F.col("_keeps") == _ALWAYS), settled, positions.where(f"NOT ({placed})"))
    return reduce(DataFrame.unionByName, [part.select(*positions.columns) for part in parts])


def _in_reach(before: str) -> str:
    """Whether a fix may follow an earlier one: there is none, a gap was recorded between them, or it isn't too far."""
    way = great_circle_sql(f"{before}.lat", f"{before}.lon", "lat", "lon")
    allowed = f"{JUMP_SLACK_M}D + {JUMP_MPS}D * greatest((mono_ms - {before}.mono_ms) / 1000.0D, 1.0D)"
    return f"({before}.seq IS NULL OR coalesce(_gap_seq > {before}.seq, false) OR {way} <= {allowed})"


def _judge_slice(rows: pa.Table, width: int) -> pa.Table:
    """For each fix of a slice that isn't calm, the entry states (as bits) in which it is kept, and the state after it by entry state.

    The fixes between those listed are calm: whatever was before them, the state after them is 0.
    """
    rows = rows.sort_by("_pos")
    pos, reached = (rows.column(c).to_numpy() for c in ("_pos", "_reached"))
    states = np.arange(_STATES)
    kept = ((reached[:, None] >> states) & 1 == 1) | (states == MAX_REJECTS)
    after = np.where(kept, 0, states + 1)
    follows = np.concatenate(([pos[0] % width == 0], pos[1:] == pos[:-1] + 1))
    after[~follows] = after[~follows][:, :1]
    step = 1
    while step < len(after):
        # Each map is composed with the one that many fixes earlier, so twice as many are behind it.
        after[step:] = np.take_along_axis(after[step:], after[:-step], axis=1)
        step *= 2
    keeps = ((after == 0) << states).sum(1)
    packed = (after << (3 * states)).sum(1)
    return rows.append_column("_keeps", pa.array(keeps, pa.int32())).append_column("_after", pa.array(packed, pa.int32()))


def _pass_on(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which the slice after each listed one is entered; a slice that isn't listed leaves state 0."""
    group, part, state = None, None, 0
    for batch in batches:
        out = []
        for root, at, after in batch[["content_root", "_part", "_after"]].itertuples(index=False):
            if (root, at) != (group, part):
                state = 0
            state = after >> (3 * state) & 7
            group, part = root, at + 1
            out.append((root, part, state))
        yield pd.DataFrame(out, columns=["content_root", "_part", "_entry"])


# --- checks -----------------------------------------------------------------------------------


def frame_verdicts(frames: DataFrame) -> DataFrame:
    """Frames (content_root, pos, seq, crc, prev_crc) with the first break of each bundle's chain.

    A frame must name the checksum of the one before it (0 for the first) and carry
    the next sequence number. Adds ``reason`` and ``kept``: nothing from the first
    break on is kept.
    """
    linked = neighbour(frames, ROOT, ["pos"], "pos", SEQ_SLICE, ["seq", "crc"], "before")
    reason = F.when(F.col("prev_crc") != F.coalesce("before.crc", F.lit(0)), "chain_break").when(
        F.col("seq") != F.col("before.seq") + 1, "seq_gap"
    )
    marked = linked.withColumn("reason", reason).drop("before")
    first = (
        marked.where("reason IS NOT NULL")
        .groupBy(*ROOT)
        .agg(F.min(F.struct("pos", "reason")).alias("stop"))
        .select("content_root", F.col("stop.pos").alias("stop_pos"), F.col("stop.reason").alias("stop_reason"))
    )
    return marked.join(first, ROOT, "left").withColumn(
        "kept", F.col("stop_pos").isNull() | (F.col("pos") < F.col("stop_pos"))
    )


def chain_report(frames: DataFrame) -> DataFrame:
    """Kept and discarded frames per bundle and why the chain stopped."""
    return (
        frame_verdicts(frames)
        .groupBy(*ROOT, "stop_reason")
        .agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("discarded"))
        .select("content_root", "kept", "discarded", F.coalesce("stop_reason", F.lit("eof")).alias("reason"))
    )


def stored_counts(t: Mapping[str, DataFrame], tables: Sequence[str] = COUNTED_TABLES) -> DataFrame:
    """Rows per bundle and table."""
    parts = [t[n].select("content_root", F.lit(n).alias("kind")) for n in tables]
    return reduce(DataFrame.unionByName, parts).groupBy(*ROOT, "kind").agg(F.count(F.lit(1)).alias("stored"))


def declared_counts(bundles: DataFrame, tables: Sequence[str] = COUNTED_TABLES) -> DataFrame:
    pairs = ", ".join(f"'{n}', n_{n}" for n in tables)
    return bundles.selectExpr("content_root", f"stack({len(tables)}, {pairs}) AS (kind, declared)")


def count_problems(t: Tables) -> DataFrame:
    """Bundles and tables where the stored rows differ from the declared number."""
    both = declared_counts(t.bundles).join(stored_counts(t), [*ROOT, "kind"], "left")
    both = both.select("content_root", "kind", "declared", F.coalesce("stored", F.lit(0)).alias("stored"))
    return both.where("declared <> stored")


def vehicle_problems(t: Tables) -> DataFrame:
    """Rows per table filed under another vehicle than their bundle's."""
    parts = [t[n].select("content_root", "vehicle_id", F.lit(n).alias("kind")) for n in COUNTED_TABLES]
    counted = reduce(DataFrame.unionByName, parts).groupBy(*ROOT, "vehicle_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    owner = t.bundles.select("content_root", F.col("vehicle_id").alias("owner"))
    return (
        counted.join(owner, ROOT)
        .where(~F.col("vehicle_id").eqNullSafe(F.col("owner")))
        .groupBy("kind")
        .agg(F.sum("n").alias("stray_rows"))
    )


def manifest_problems(manifest: DataFrame, declared: DataFrame, t: Mapping[str, DataFrame], tables: Sequence[str]) -> DataFrame:
    """Where a manifest (content_root, first_seq, last_seq) and its record counts disagree with the rows.

    ``declared`` holds content_root, kind, declared. A kind that has rows but is not
    declared is a problem too.
    """
    parts = [t[n].select("content_root", "seq", F.lit(n).alias("kind")) for n in tables]
    seen = (
        reduce(DataFrame.unionByName, parts)
        .groupBy(*ROOT, "kind")
        .agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("stored"))
    )
    bounds = seen.groupBy(*ROOT).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ranges = (
        manifest.join(bounds, ROOT)
        .where((F.col("first_seq") != F.col("lo")) | (F.col("last_seq") != F.col("hi")))
        .select(
            "content_root",
            F.lit("seq_range").alias("problem"),
            F.concat_ws("..", "first_seq", "last_seq").alias("claimed"),
            F.concat_ws("..", "lo", "hi").alias("found"),
        )
    )
    zero = F.lit(0)
    counts = (
        declared.join(seen.select(*ROOT, "kind", "stored"), [*ROOT, "kind"], "full")
        .where(F.coalesce("declared", zero) != F.coalesce("stored", zero))
        .select(
            "content_root",
            F.concat(F.lit("count:"), "kind").alias("problem"),
            F.when(F.col("declared").isNull(), "none").otherwise(F.col("declared").cast("string")).alias("claimed"),
            F.coalesce("stored", zero).cast("string").alias("found"),
        )
    )
    return ranges.unionByName(counts)


# --- digests ----------------------------------------------------------------------------------

DIGEST_DIGITS = 15


def bundle_digests(t: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """A digest of each bundle's rows that does not depend on their order.

    Every row is hashed; pieces of the hashes are summed, which partial aggregation
    can do anywhere, and the sums are hashed. Nothing is sorted or collected. A value goes in with its length
    in front, a missing one as ``-``, so no two rows have the same text.
    """
    parts = []
    for name, cols in columns.items():
        values = [F.col(c).cast("string") for c in cols]
        text = F.concat(F.lit(name), *[F.coalesce(F.concat(F.char_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])
        parts.append(t[name].select("content_root", F.sha2(text, 256).alias("h")))
    pieces = [
        F.sum(F.conv(F.substring("h", 1 + i * DIGEST_DIGITS, DIGEST_DIGITS), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
        for i in range(4)
    ]
    sums = reduce(DataFrame.unionByName, parts).groupBy(*ROOT).agg(F.count(F.lit(1)).alias("rows"), *pieces)
    return sums.select(
        "content_root", "rows", F.sha2(F.concat_ws(":", "rows", "s0", "s1", "s2", "s3"), 256).alias("output_digest")
    )


def reproducibility(first: DataFrame, second: DataFrame) -> DataFrame:
    """Compare two runs (content_root, output_digest): same, changed, or present in one only."""
    a = first.select("content_root", F.col("output_digest").alias("first_digest"))
    b = second.select("content_root", F.col("output_digest").alias("second_digest"))
    verdict = (
        F.when(F.col("first_digest").isNull(), "second_only")
        .when(F.col("second_digest").isNull(), "first_only")
        .when(F.col("first_digest") == F.col("second_digest"), "same")
        .otherwise("changed")
    )
    return a.join(b, ROOT, "full").withColumn("verdict", verdict)


def changed_between_versions(runs: DataFrame, old_version: int, new_version: int) -> DataFrame:
    """Bundles whose digest differs between two decoder versions of the decode-run table."""
    a = runs.where(F.col("decoder_version") == old_version)
    b = runs.where(F.col("decoder_version") == new_version)
    return reproducibility(a, b).where("verdict = 'changed'").drop("verdict")


def repaired(t: Tables, corrections: Sequence[Correction] = (), gate: bool = False) -> Tables:
    """All repairs in their order: jump gate, corrections, mixed boots, speed sentinel, undated bundles.

    The gate is for positions that didn't pass it yet (what ``load`` stores did): it may refuse more when it is run again.
    """
    if gate:
        t = t.replace(position=settle(jump_gate(t.position, t.gap)))
    if corrections:
        t = apply_corrections(t, corrections)
    t = file_mixed_boots(t)
    t = t.replace(obd=clear_unavailable_speed(t.obd))
    return date_undated(t)
