"""Legs and outings: sessions over a vehicle's timeline, and everything counted inside them.

All samples are first reduced to one row per vehicle and time slice. A slice is
no longer than the break that ends a session, so it lies in one session as a
whole, and the only window over a vehicle runs on slices.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.functions.flags import from_device
from odolake.functions.geo import great_circle_m
from odolake.functions.timecols import from_millis, millis
from odolake.operators.asof import MINUTE_MS
from odolake.operators.slices import SLICE, near_neighbours, number_sessions, slice_of
from odolake.operators.spans import overlapping, points_in_spans
from odolake.plans.summaries import joined_distinct
from odolake.plans.trusted import v_position_trusted
from odolake.session import settle
from odolake.sources.tables import Tables

LEG_BREAK_MS = 60_000
TRIP_BREAK_MS = 3_600_000
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
MOVING_KPH = 3
BRIDGE_MS = 5000
CLOCK_SET_MS = 946_684_800_000  # 2000-01-01; earlier times come from a clock that was never set
TRIP = ["vehicle_id", "trip_no"]


def minute_rollup(t: Tables) -> DataFrame:
    """Position, engine and motion samples per vehicle, bundle, boot and wall-clock minute.

    Status records are left out: they keep ticking while parked. A sample without
    a wall-clock time has no place on a timeline.
    """
    keys = ["vehicle_id", "content_root", "boot_id", "observed_at"]
    rows = (
        t.position.select(*keys, F.when(from_device(), 1).alias("dev"))
        .unionByName(
            t.obd.select(*keys, F.lit(1).alias("obd"), F.col("speed_kph").alias("kph"), "rpm"), allowMissingColumns=True
        )
        .unionByName(t.imu.select(*keys), allowMissingColumns=True)
        .where("observed_at IS NOT NULL")
        .withColumn("at", millis("observed_at"))
    )
    moving = F.when((F.col("kph") > MOVING_KPH) & (F.col("at") > CLOCK_SET_MS), F.col("at"))
    return rows.groupBy(*keys[:3], slice_of("at", MINUTE_MS).alias(SLICE)).agg(
        F.min("at").alias("lo"),
        F.max("at").alias("hi"),
        F.min(F.when(F.col("obd") == 1, F.col("at"))).alias("obd_lo"),
        F.count("obd").alias("obd_samples"),
        F.max("kph").alias("max_obd_speed_kph"),
        F.max("rpm").alias("max_rpm"),
        F.count("dev").alias("gnss_samples"),
        F.min(moving).alias("moving_lo"),
        F.max(moving).alias("moving_hi"),
    )


def v_trip_leg(t: Tables, trusted: DataFrame | None = None, minutes: DataFrame | None = None) -> DataFrame:
    """Stretches of movement with no break over 60 s, from wheel speed and trusted device fixes."""
    trusted = v_position_trusted(t) if trusted is None else trusted
    minutes = minute_rollup(t) if minutes is None else minutes
    fixes = trusted.where(F.col("trusted") & (F.col("speed_mps") * 3.6 > MOVING_KPH) & from_device())
    fixes = fixes.withColumn("at", millis("observed_at")).where(F.col("at") > CLOCK_SET_MS)
    from_fixes = fixes.groupBy("vehicle_id", slice_of("at", MINUTE_MS).alias(SLICE), "boot_id").agg(
        F.min("at").alias("lo"), F.max("at").alias("hi")
    )
    from_wheels = minutes.where("moving_lo IS NOT NULL").select(
        "vehicle_id", SLICE, "boot_id", F.col("moving_lo").alias("lo"), F.col("moving_hi").alias("hi")
    )
    per_slice = (
        from_wheels.unionByName(from_fixes)
        .groupBy("vehicle_id", SLICE)
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min(F.struct("lo", "boot_id")).alias("first"))
    )
    legs = number_sessions(per_slice, ["vehicle_id"], "lo", "hi", LEG_BREAK_MS, "leg_no")
    return (
        legs.groupBy("vehicle_id", "leg_no")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"))
        .select(
            "vehicle_id",
            from_millis("lo").alias("started_at"),
            from_millis("hi").alias("closed_at"),
            F.col("first.boot_id").alias("boot_id"),
        )
    )


@dataclass(frozen=True)
class Outings:
    """Trips with their sample totals, and the trip each minute of a vehicle belongs to."""

    trips: DataFrame
    minutes: DataFrame


def outings(t: Tables, minutes: DataFrame | None = None) -> Outings:
    """Sessions of position, engine and motion samples with no break over an hour."""
    minutes = minute_rollup(t) if minutes is None else minutes
    totals = [
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.sum("obd_samples").alias("obd_samples"),
        F.max("max_obd_speed_kph").alias("max_obd_speed_kph"),
        F.max("max_rpm").alias("max_rpm"),
        F.sum("gnss_samples").alias("gnss_samples"),
    ]
    first = F.when(F.col("obd_lo").isNotNull(), F.struct("obd_lo", "boot_id"))
    per_slice = minutes.groupBy("vehicle_id", SLICE).agg(*totals, F.min(first).alias("first"))
    numbered = number_sessions(per_slice, ["vehicle_id"], "lo", "hi", TRIP_BREAK_MS, "trip_no")
    trips = numbered.groupBy(*TRIP).agg(*totals, F.min("first").alias("first"))
    trips = trips.withColumn("boot_id", F.col("first.boot_id")).drop("first")
    return Outings(trips, numbered.select("vehicle_id", SLICE, "trip_no"))


def _in_trip(rows: DataFrame, at: str, found: Outings) -> DataFrame:
    """Trip of rows that are themselves trip samples: a plain join on the minute."""
    placed = rows.withColumn(SLICE, slice_of(at, MINUTE_MS))
    return placed.join(found.minutes, ["vehicle_id", SLICE]).drop(SLICE)


def trip_distance(fixes: DataFrame) -> DataFrame:
    """Distance per trip over steps of at most 5 s between fixes of the same boot."""
    by = [*TRIP, "boot_id"]
    steps = near_neighbours(
        fixes, by, ["mono_ms", "seq"], "mono_ms", BRIDGE_MS, MINUTE_MS, ["mono_ms", "lat", "lon"], before="prev"
    )
    step = great_circle_m("prev.lat", "prev.lon", "lat", "lon")
    near = F.col("mono_ms") - F.col("prev.mono_ms") <= BRIDGE_MS
    return steps.groupBy(*TRIP).agg(
        F.count(F.lit(1)).alias("fix_samples"),
        F.max("speed_mps").alias("max_gnss_speed_mps"),
        F.coalesce(F.sum(F.when(near, step).otherwise(0.0)), F.lit(0.0)).alias("distance_m"),
    )


def v_trip_summary(
    t: Tables, trusted: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = settle
) -> DataFrame:
    """One row per outing.

    The minute rollup, the verdicts on fixes and the trips feed several branches
    each, so they are computed once and kept; pass another ``keep`` to decide how.
    """
    trusted = v_position_trusted(t) if trusted is None else trusted
    trusted = keep(
        trusted.where(F.col("trusted") & from_device() & F.col("observed_at").isNotNull()).select(
            "vehicle_id", "boot_id", "mono_ms", "seq", "observed_at", "lat", "lon", "speed_mps", "fix_type",
            "source_flags", "trusted",
        )
    )
    minutes = keep(minute_rollup(t))
    found = outings(t, minutes)
    found = Outings(keep(found.trips), found.minutes)
    spans = found.trips.select(*TRIP, "lo", "hi")

    legs = v_trip_leg(t, trusted, minutes).select(
        "vehicle_id", millis("started_at").alias("leg_lo"), (millis("closed_at") - millis("started_at")).alias("took")
    )
    legs = (
        _in_trip(legs, "leg_lo", found)
        .groupBy(*TRIP)
        .agg(F.count(F.lit(1)).alias("leg_count"), F.sum("took").alias("driving_ms"))
    )
    fixes = trusted.where(F.col("fix_type") > 0).select(
        "vehicle_id", "boot_id", "mono_ms", "seq", "lat", "lon", "speed_mps", millis("observed_at").alias("at")
    )
    gnss = trip_distance(_in_trip(fixes, "at", found))
    boost = t.boost.where("observed_at IS NOT NULL").select("vehicle_id", millis("observed_at").alias("at"))
    boost = (
        points_in_spans(boost, "at", spans, "lo", "hi", ["vehicle_id"], HOUR_MS)
        .groupBy(*TRIP)
        .agg(F.count(F.lit(1)).alias("boost_samples"))
    )
    gaps = t.gap.where("started_at IS NOT NULL").select("vehicle_id", "duration_ms", millis("started_at").alias("at"))
    gaps = (
        points_in_spans(gaps, "at", spans, "lo", "hi", ["vehicle_id"], HOUR_MS)
        .groupBy(*TRIP)
        .agg(
            F.count(F.lit(1)).alias("gap_count"),
            F.sum("duration_ms").alias("gap_duration_ms"),
            F.max("duration_ms").alias("max_gap_ms"),
        )
    )
    held = _bundles_held(t, minutes, spans)
    counts = [
        "leg_count", "obd_samples", "gnss_samples", "fix_samples", "boost_samples", "gap_count", "gap_duration_ms",
        "max_gap_ms", "bundle_count",
    ]
    out = found.trips
    for part in (legs, gnss, boost, gaps, held):
        out = out.join(part, TRIP, "left")
    return out.select(
        "vehicle_id",
        "boot_id",
        "device_id",
        F.concat_ws(":", "vehicle_id", F.col("lo").cast("string")).alias("trip_id"),
        from_millis("lo").alias("started_at"),
        from_millis("hi").alias("ended_at"),
        (F.col("hi") - F.col("lo")).alias("duration_ms"),
        "driving_ms",
        "distance_m",
        "max_gnss_speed_mps",
        "max_obd_speed_kph",
        "max_rpm",
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts],
        "bundle_ids",
        "decoder_version",
    )


def _bundles_held(t: Tables, minutes: DataFrame, spans: DataFrame) -> DataFrame:
    """Bundles whose own sample span overlaps the trip."""
    span = minutes.groupBy("content_root").agg(F.min("lo").alias("b_lo"), F.max("hi").alias("b_hi"))
    bundles = t.bundles.select("content_root", "vehicle_id", "bundle_id", "device_id", "decoder_ver")
    bundles = bundles.join(span, "content_root").drop("content_root")
    pairs = overlapping(bundles, ("b_lo", "b_hi"), spans, ("lo", "hi"), ["vehicle_id"], DAY_MS)
    return pairs.groupBy(*TRIP).agg(
        joined_distinct(F.col("bundle_id"), ",").alias("bundle_ids"),
        F.count_distinct("bundle_id").alias("bundle_count"),
        F.min("device_id").alias("device_id"),
        F.max("decoder_ver").alias("decoder_version"),
    )


def v_trip_period(trips: DataFrame) -> DataFrame:
    """Calendar day, ISO week, month, quarter and year (UTC) each outing starts in."""
    start = F.col("started_at")
    return trips.where(start.isNotNull()).select(
        "vehicle_id", "boot_id", "started_at", "ended_at",
        start.cast("date").alias("started_on"),
        *[F.date_trunc(p, start).cast("date").alias(f"{p}_start") for p in ("week", "month", "quarter", "year")],
        "duration_ms", "distance_m", "max_obd_speed_kph",
        (F.col("max_gnss_speed_mps") * 3.6).alias("max_gnss_speed_kph"),
    )


def period_summary(periods: DataFrame, from_day: str, to_day: str) -> DataFrame:
    """Totals per vehicle over outings that start in ``[from_day, to_day)``."""
    lo, hi = (F.lit(d).cast("timestamp_ntz") for d in (from_day, to_day))
    return (
        periods.where((F.col("started_at") >= lo) & (F.col("started_at") < hi))
        .groupBy("vehicle_id")
        .agg(
            F.count(F.lit(1)).alias("trips"),
            F.coalesce(F.sum("duration_ms"), F.lit(0)).cast("long").alias("duration_ms"),
            F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"),
            F.max("max_obd_speed_kph").alias("max_obd_speed_kph"),
            F.max("max_gnss_speed_kph").alias("max_gnss_speed_kph"),
        )
    )


def register_period_summary(spark: SparkSession, view: str = "v_trip_period") -> None:
    """Offer ``SELECT * FROM period_summary('2026-03-01', '2026-04-01')`` to SQL users."""
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION period_summary(from_day STRING, to_day STRING)
        RETURNS TABLE (vehicle_id STRING, trips BIGINT, duration_ms BIGINT, distance_m DOUBLE,
                       max_obd_speed_kph INT, max_gnss_speed_kph DOUBLE)
        RETURN SELECT vehicle_id, count(*), cast(coalesce(sum(duration_ms), 0) AS BIGINT),
                      coalesce(sum(distance_m), 0.0D), max(max_obd_speed_kph), max(max_gnss_speed_kph)
               FROM {view}
               WHERE started_at >= cast(from_day AS TIMESTAMP_NTZ) AND started_at < cast(to_day AS TIMESTAMP_NTZ)
               GROUP BY vehicle_id
    """)


def trip_publish(trips: DataFrame) -> DataFrame:
    """Whole-number trip rows for a change feed; an unknown value becomes 0."""

    def whole(col, default=0):
        return F.round(F.coalesce(col, F.lit(default))).cast("long")

    plain = [
        "driving_ms", "leg_count", "duration_ms", "max_rpm", "obd_samples", "gnss_samples", "boost_samples",
        "gap_count", "gap_duration_ms", "bundle_count", "decoder_version",
    ]
    return trips.where(millis("started_at") != 0).select(
        F.lower("vehicle_id").alias("vehicle_id"),
        F.concat_ws(":", F.lower("vehicle_id"), millis("started_at").cast("string")).alias("entity_id"),
        F.coalesce("boot_id", F.lit("")).alias("boot_id"),
        F.coalesce("device_id", F.lit("")).alias("device_id"),
        millis("started_at").alias("started_ms"),
        millis("ended_at").alias("ended_ms"),
        whole(F.col("distance_m"), 0.0).alias("distance_m"),
        whole(F.col("max_gnss_speed_mps") * 100, 0.0).alias("max_gnss_speed_cmps"),
        whole(F.col("max_obd_speed_kph") * 100 / 3.6, 0.0).alias("max_obd_speed_cmps"),
        *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in plain],
    )
