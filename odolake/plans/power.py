"""Standby windows and battery voltage while parked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions.names import WAKE_REASONS, named
from odolake.operators.slices import neighbour
from odolake.sources.tables import Tables

# Fixed values of the state machine.
HEALTH_REGION = 4
POWER_TRIGGER = 4
AWAKE = 0
STANDBY = 1
CLOCK_WRAP = 4294967296
MIN_DRAIN_SPAN_MS = 600_000
SEQ_SLICE = 65_536


def elapsed(start: Column, end: Column) -> Column:
    """Milliseconds between two readings of a clock that wraps at 32 bits."""
    return F.pmod(end - start, F.lit(CLOCK_WRAP))


def power_windows(t: Tables) -> DataFrame:
    """Each entry into standby with the next exit of its bundle.

    An entry followed by another entry, or by nothing, is unmatched; an exit
    without an entry before it gives no window.
    """
    enter = (F.col("from_state") == AWAKE) & (F.col("to_state") == STANDBY)
    leave = (F.col("from_state") == STANDBY) & (F.col("to_state") == AWAKE)
    steps = t.transition.where((F.col("region") == HEALTH_REGION) & (F.col("trigger_event") == POWER_TRIGGER))
    steps = steps.where(enter | leave).select(
        "vehicle_id", "content_root", "boot_id", "seq", "mono_ms", "observed_at", "reason_code", enter.alias("enters")
    )
    cols = ["mono_ms", "observed_at", "reason_code", "enters"]
    paired = neighbour(steps, ["content_root"], ["seq"], "seq", SEQ_SLICE, cols, "nxt", following=True)
    matched = F.coalesce(~F.col("nxt.enters"), F.lit(False))
    return paired.where("enters").select(
        "vehicle_id",
        "content_root",
        "boot_id",
        "seq",
        F.col("mono_ms").alias("enter_ms"),
        F.when(matched, F.col("nxt.mono_ms")).alias("exit_ms"),
        F.when(matched, elapsed(F.col("mono_ms"), F.col("nxt.mono_ms"))).otherwise(0).alias("duration_ms"),
        F.when(matched, F.col("nxt.reason_code")).alias("wake_reason"),
        F.when(matched, named(F.col("nxt.reason_code"), WAKE_REASONS, "unknown")).alias("wake_reason_name"),
        (~matched).alias("unmatched"),
        F.col("observed_at").alias("enter_at"),
        F.when(matched, F.col("nxt.observed_at")).alias("exit_at"),
    )


def power_summary(t: Tables) -> DataFrame:
    """Standby share and voltage drop per bundle; a drain rate only over ten minutes or more."""
    windows = (
        power_windows(t)
        .groupBy("content_root")
        .agg(
            F.sum("duration_ms").alias("standby_ms"),
            F.count(F.lit(1)).alias("windows"),
            F.count_if("unmatched").alias("unmatched_windows"),
        )
    )
    both = t.transition.select("content_root", "mono_ms").unionByName(t.status.select("content_root", "mono_ms"))
    span = both.groupBy("content_root").agg((F.max("mono_ms") - F.min("mono_ms")).alias("observed_span_ms"))
    reading = F.struct("battery_mv", "mono_ms")
    volts = (
        t.status.where("battery_mv IS NOT NULL")
        .groupBy("content_root")
        .agg(
            F.count(F.lit(1)).alias("voltage_samples"),
            F.min_by(reading, "seq").alias("a"),
            F.max_by(reading, "seq").alias("b"),
        )
    )
    took = elapsed(F.col("a.mono_ms"), F.col("b.mono_ms"))
    long_enough = took >= MIN_DRAIN_SPAN_MS
    rate = (F.col("b.battery_mv") - F.col("a.battery_mv")) / (took / 3_600_000.0)
    standby = F.coalesce("standby_ms", F.lit(0))
    whole = span.join(windows, "content_root", "left").join(volts, "content_root", "left")
    return whole.select(
        "content_root",
        standby.cast("long").alias("standby_ms"),
        "observed_span_ms",
        F.when(F.col("observed_span_ms") > 0, standby / F.nullif(F.col("observed_span_ms"), F.lit(0)))
        .otherwise(0.0)
        .alias("standby_fraction"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("windows", "unmatched_windows", "voltage_samples")],
        F.col("a.battery_mv").alias("first_mv"),
        F.col("b.battery_mv").alias("last_mv"),
        (F.col("a.battery_mv") - F.col("b.battery_mv")).alias("drop_mv"),
        F.when(long_enough, took).alias("drain_span_ms"),
        F.when(long_enough, rate).alias("drain_mv_per_hour"),
    )
