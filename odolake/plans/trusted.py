"""Which position fixes the rest of the car's data supports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT, from_phone
from odolake.operators.asof import MINUTE_MS
from odolake.operators.slices import SLICE, slice_of, with_edge_copies
from odolake.sources.tables import Tables

FAST_MPS = 8
QUIET_MG = 35
QUIET_SECONDS = 3
FEW_SATELLITES = 6
NEIGHBOUR_MS = 2000
OVER_WHEELS_MPS = 4
MAX_ACCEL = 10


def v_position_trusted(t: Tables) -> DataFrame:
    """Every fix with a verdict. Missing evidence never counts against a fix.

    Fixes, wheel speeds and per-second motion levels share one shuffle on
    ``(boot, minute)``. All evidence lies within 3 s of a fix, so copies of the
    rows near a minute's edge make each minute complete on its own.
    """
    fixes = t.position.select(
        *BOOT,
        F.col("mono_ms").alias("_on"),
        F.col("seq").alias("_tie"),
        F.lit(1).alias("_rank"),
        F.struct("mono_ms", "speed_mps", from_phone().alias("phone")).alias("_near"),
        F.struct(*t.position.columns).alias("_fix"),
    )
    fixes = with_edge_copies(fixes, "_on", MINUTE_MS, before=NEIGHBOUR_MS, after=NEIGHBOUR_MS)
    wheels = t.obd.where("speed_kph IS NOT NULL").select(
        *BOOT,
        F.col("mono_ms").alias("_on"),
        F.col("seq").alias("_tie"),
        F.lit(0).alias("_rank"),
        F.struct("mono_ms", "speed_kph").alias("_wheel"),
    )
    wheels = with_edge_copies(wheels, "_on", MINUTE_MS, before=NEIGHBOUR_MS, after=NEIGHBOUR_MS)
    second = F.floor(F.col("mono_ms") / 1000).cast("long")
    motion = (
        t.imu.groupBy(*BOOT, second.alias("_sec"))
        .agg(F.avg("accel_rms_mg").alias("_rms"))
        .withColumn("_on", F.col("_sec") * 1000)
        .withColumns({"_rank": F.lit(0), "_tie": F.lit(0).cast("long"), "_motion": F.lit(True)})
        .drop("_sec")
    )
    reach = (QUIET_SECONDS + 1) * 1000
    motion = with_edge_copies(motion, "_on", MINUTE_MS, before=reach, after=reach)
    rows = fixes.unionByName(wheels, allowMissingColumns=True).unionByName(motion, allowMissingColumns=True)
    rows = rows.withColumn("_sec", F.floor(F.col("_on") / 1000).cast("long"))

    part = Window.partitionBy(*BOOT, SLICE)
    ahead = part.orderBy("_on", "_rank", "_tie")
    behind = part.orderBy(F.desc("_on"), "_rank", F.when(F.col("_rank") == 1, -F.col("_tie")).otherwise(F.col("_tie")))

    def upto(window, offset):
        return window.rowsBetween(Window.unboundedPreceding, offset)

    phone = F.col("_near.phone")
    rows = rows.withColumns(
        {
            "_wheel_before": F.last("_wheel", ignorenulls=True).over(upto(ahead, 0)),
            "_prev_phone": F.last(F.when(phone, F.col("_near")), ignorenulls=True).over(upto(ahead, -1)),
            "_prev_device": F.last(F.when(~phone, F.col("_near")), ignorenulls=True).over(upto(ahead, -1)),
        }
    )
    rows = rows.withColumns(
        {
            "_wheel_after": F.last("_wheel", ignorenulls=True).over(upto(behind, 0)),
            "_next_phone": F.last(F.when(phone, F.col("_near")), ignorenulls=True).over(upto(behind, -1)),
            "_next_device": F.last(F.when(~phone, F.col("_near")), ignorenulls=True).over(upto(behind, -1)),
        }
    )
    near = part.orderBy("_sec")
    rows = rows.withColumns(
        {
            "_quiet": F.min("_rms").over(near.rangeBetween(-QUIET_SECONDS, QUIET_SECONDS)),
            "_has_motion": F.max("_motion").over(near.rangeBetween(0, 0)),
        }
    )
    rows = rows.where(F.col("_fix").isNotNull() & (F.col(SLICE) == slice_of("_on", MINUTE_MS)))

    speed = F.col("_fix.speed_mps")
    at = F.col("_on")
    prev = F.when(phone, F.col("_prev_phone")).otherwise(F.col("_prev_device"))
    nxt = F.when(phone, F.col("_next_phone")).otherwise(F.col("_next_device"))
    before_age = at - F.col("_wheel_before.mono_ms")
    after_age = F.col("_wheel_after.mono_ms") - at
    fastest_wheel = F.greatest("_wheel_before.speed_kph", "_wheel_after.speed_kph")

    def jumps(a_ms, a_speed, b_ms, b_speed):
        took = b_ms - a_ms
        return (took > 0) & (took <= NEIGHBOUR_MS) & (F.abs(b_speed - a_speed) * 1000.0 / F.nullif(took, F.lit(0)) > MAX_ACCEL)

    doubted = (
        ((speed >= FAST_MPS) & F.col("_has_motion") & (F.col("_quiet") < QUIET_MG))
        | (F.col("_fix.sats_used") < FEW_SATELLITES)
        | (
            (before_age <= NEIGHBOUR_MS)
            & (after_age <= NEIGHBOUR_MS)
            & (speed > fastest_wheel / 3.6 + OVER_WHEELS_MPS)
        )
        | jumps(prev["mono_ms"], prev["speed_mps"], at, speed)
        | jumps(at, speed, nxt["mono_ms"], nxt["speed_mps"])
    )
    return rows.select("_fix.*", (~F.coalesce(doubted, F.lit(False))).alias("trusted"))
