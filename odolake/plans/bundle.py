"""Per-bundle trips, segments, routes, events, and the daily rollup over them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions.geo import great_circle_m
from odolake.functions.ids import event_id, trip_id
from odolake.functions.names import gap_cause, health_names, trip_event
from odolake.functions.timecols import from_millis, millis
from odolake.operators.slices import neighbour, row_numbers, running
from odolake.session import settle
from odolake.sources.tables import Tables

ROOT = ["content_root"]
SEQ_SLICE = 65_536
MINUTE_MS = 60_000
BRIDGE_S = 5
STOP_MPS = 1.0
MIN_STOP_S = 30
ROUTE_PART = 4096

# IMU window flags and event limits.
IMPACT_FLAG = 1
HARD_BRAKE_FLAG = 2
POTHOLE_FLAG = 8
HARD_BRAKE_MG = 800
IMPACT_MG = 3000
LOW_STORAGE_MIB = 256
LONG_GAP_MS = 10_000


def _route_fixes(t: Tables) -> DataFrame:
    """Fixes with the previous fix of their bundle in sequence order."""
    fixes = t.position.where("fix_type <> 0").select(
        "content_root", "seq", millis("observed_at").alias("at"), "lat", "lon", "speed_mps"
    )
    return neighbour(fixes, ROOT, ["seq"], "seq", SEQ_SLICE, ["at", "lat", "lon", "speed_mps"], "prev")


def _step() -> Column:
    """Metres from the previous fix; 0 across an interruption, whose path is unknown."""
    near = F.col("at") - F.col("prev.at") <= BRIDGE_S * 1000
    away = great_circle_m("prev.lat", "prev.lon", "lat", "lon")
    return F.when(F.col("prev").isNotNull() & near, away).otherwise(0.0)


def bundle_trips(t: Tables) -> DataFrame:
    """One trip per bundle with observations; a bundle without a fix has a trip without a route."""
    seen = [t[n].select("content_root", "observed_at") for n in ("position", "imu", "obd", "status")]
    bounds = (
        reduce(DataFrame.unionByName, seen)
        .groupBy(*ROOT)
        .agg(F.min("observed_at").alias("started_at"), F.max("observed_at").alias("ended_at"))
    )
    samples = t.position.groupBy(*ROOT).agg(F.count(F.lit(1)).alias("sample_count"))
    gaps = t.gap.groupBy(*ROOT).agg(
        F.count(F.lit(1)).alias("gap_count"), F.sum(F.expr("duration_ms div 1000")).alias("gap_duration_s")
    )
    place = F.struct("lat", "lon")
    route = _route_fixes(t).groupBy(*ROOT).agg(
        F.sum(_step()).alias("distance_m"),
        F.min_by(place, "seq").alias("first"),
        F.max_by(place, "seq").alias("last"),
        F.greatest(F.max("speed_mps"), F.lit(0.0)).alias("top"),
        F.avg("speed_mps").alias("avg_speed_mps"),
    )
    owner = t.bundles.select("content_root", "vehicle_id", "device_id")
    out = bounds.join(owner, ROOT, "left")
    for part in (samples, gaps, route):
        out = out.join(part, ROOT, "left")
    return out.select(
        trip_id().alias("trip_id"),
        "content_root",
        "vehicle_id",
        "device_id",
        "started_at",
        "ended_at",
        F.expr("(unix_millis(cast(ended_at AS timestamp)) - unix_millis(cast(started_at AS timestamp))) div 1000").alias("duration_s"),
        F.coalesce("distance_m", F.lit(0.0)).alias("distance_m"),
        F.col("first.lat").alias("start_lat"),
        F.col("first.lon").alias("start_lon"),
        F.col("last.lat").alias("end_lat"),
        F.col("last.lon").alias("end_lon"),
        F.when(F.col("avg_speed_mps").isNotNull(), F.col("top")).alias("max_speed_mps"),
        "avg_speed_mps",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("sample_count", "gap_count", "gap_duration_s")],
    )


def _point(lon: Column, lat: Column) -> Column:
    return F.concat_ws(" ", F.format_string("%.7f", lon), F.format_string("%.7f", lat))


def bundle_routes(t: Tables) -> DataFrame:
    """Route of each bundle as WKT from its second fix on, with its end points; fixes without a place are left out.

    The text is put together from parts of a few thousand points, so no task holds a
    bundle's fixes, only its finished text.
    """
    fixes = t.position.where("fix_type <> 0 AND lat IS NOT NULL AND lon IS NOT NULL").select("content_root", "seq", "lat", "lon")
    numbered = row_numbers(fixes, ROOT, ["seq"], "seq", SEQ_SLICE, "n")
    parts = numbered.groupBy(*ROOT, F.expr(f"(n - 1) div {ROUTE_PART}").alias("part")).agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("n", _point(F.col("lon"), F.col("lat")).alias("p")))), lambda x: x["p"]
            ),
            ",",
        ).alias("text"),
        F.count(F.lit(1)).alias("points"),
        F.min_by(F.struct("lon", "lat"), "n").alias("a"),
        F.max_by(F.struct("lon", "lat"), "n").alias("b"),
    )
    whole = parts.groupBy(*ROOT).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), ",").alias("text"),
        F.sum("points").alias("points"),
        F.min_by("a", "part").alias("a"),
        F.max_by("b", "part").alias("b"),
    )

    def point(end: str) -> Column:
        return F.concat(F.lit("POINT("), _point(F.col(f"{end}.lon"), F.col(f"{end}.lat")), F.lit(")"))

    return whole.select(
        "content_root",
        trip_id().alias("trip_id"),
        F.when(F.col("points") >= 2, F.concat(F.lit("LINESTRING("), "text", F.lit(")"))).alias("route_wkt"),
        point("a").alias("start_wkt"),
        point("b").alias("end_wkt"),
        "points",
    )


def trip_segments(t: Tables) -> DataFrame:
    """Drive, stop and gap phases of each bundle in time order.

    A run of slow fixes is a stop from 30 s on and otherwise a piece of driving; a
    fix without a speed counts as moving.
    """
    moving = F.coalesce(F.col("speed_mps") >= STOP_MPS, F.lit(True))
    before = F.coalesce(F.col("prev.speed_mps") >= STOP_MPS, F.lit(True))
    fixes = _route_fixes(t).withColumn("moving", moving)
    opens = F.col("prev").isNull() | (F.col("moving") != before)
    fixes = fixes.withColumn("opens", opens).withColumn("step", F.when(F.col("opens"), 0.0).otherwise(_step()))
    fixes = fixes.drop("prev")
    runs = running(fixes, ROOT, ["seq"], "seq", SEQ_SLICE, {"run": ("last", F.when(F.col("opens"), F.col("seq")))})
    phases = runs.groupBy(*ROOT, "run", "moving").agg(
        F.min_by("at", "seq").alias("a"), F.max_by("at", "seq").alias("b"), F.sum("step").alias("m")
    )
    took = F.expr("(b - a) div 1000")
    stop = ~F.col("moving") & (took >= MIN_STOP_S)
    phases = phases.select(
        "content_root",
        F.when(stop, "stop").otherwise("drive").alias("kind"),
        "a",
        "b",
        took.alias("duration_s"),
        F.when(stop, 0.0).otherwise(F.col("m")).alias("distance_m"),
        F.col("run").alias("seq"),
    )
    gaps = t.gap.select("content_root", millis("started_at").alias("a"), "duration_ms", "seq").join(
        phases.select("content_root").distinct(), ROOT, "left_semi"
    )
    gaps = gaps.select(
        "content_root",
        F.lit("gap").alias("kind"),
        "a",
        (F.col("a") + F.col("duration_ms")).alias("b"),
        F.expr("duration_ms div 1000").alias("duration_s"),
        F.lit(0.0).alias("distance_m"),
        "seq",
    )
    ordered = row_numbers(phases.unionByName(gaps), ROOT, ["a", "kind", "seq"], "a", MINUTE_MS, "n")
    return ordered.select(
        trip_id().alias("trip_id"),
        "content_root",
        (F.col("n") - 1).alias("segment_index"),
        "kind",
        from_millis("a").alias("started_at"),
        from_millis("b").alias("ended_at"),
        "duration_s",
        "distance_m",
    )


def _event(rows: DataFrame, kind: str, at: str, detail: Mapping[str, Column], lat: str | None = None, lon: str | None = None) -> DataFrame:
    pairs = [c for k, v in detail.items() for c in (F.lit(k), v.cast("string"))]
    text = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    where = [F.col(c) if c else F.lit(None).cast("double") for c in (lat, lon)]
    return rows.select(
        event_id("content_root", F.lit(kind), F.col("seq").cast("string")).alias("event_id"),
        "content_root",
        "vehicle_id",
        F.lit(kind).alias("kind"),
        F.col(at).alias("occurred_at"),
        F.col("seq").cast("long").alias("seq"),
        where[0].alias("lat"),
        where[1].alias("lon"),
        text.alias("detail"),
    )


def sample_events(t: Tables) -> DataFrame:
    """Events that one row decides on its own: a filter per rule. Works on streams as well."""
    imu = t.imu
    flags = F.coalesce("event_flags", F.lit(0))
    rms = F.col("accel_rms_mg")

    def flagged(bit: int, level: int | None = None) -> Column:
        hit = flags.bitwiseAND(bit) != 0
        return hit if level is None else hit | F.coalesce(rms >= level, F.lit(False))

    shaken = {"accel_rms_mg": rms}
    gaps = t.gap.where(F.col("duration_ms") >= LONG_GAP_MS)
    return reduce(
        DataFrame.unionByName,
        [
            _event(imu.where(flagged(HARD_BRAKE_FLAG, HARD_BRAKE_MG)), "hard_braking_detected", "observed_at", shaken),
            _event(imu.where(flagged(IMPACT_FLAG, IMPACT_MG)), "impact_detected", "observed_at", shaken),
            _event(imu.where(flagged(POTHOLE_FLAG)), "pothole_detected", "observed_at", {}),
            _event(
                t.status.where(F.col("sd_free_mib") < LOW_STORAGE_MIB),
                "storage_attention_required",
                "observed_at",
                {"sd_free_mib": F.col("sd_free_mib")},
            ),
            _event(
                t.status.where(F.col("sd_write_errors") > 0),
                "storage_errors_observed",
                "observed_at",
                {"sd_write_errors": F.col("sd_write_errors")},
            ),
            _event(gaps, "gnss_gap_observed", "started_at", {"duration_ms": F.col("duration_ms"), "cause": F.col("cause")}),
        ],
    )


def trip_events(trips: DataFrame) -> DataFrame:
    """Start and end of each bundle trip."""
    first = trips.withColumn("seq", F.lit(0))
    last = trips.withColumn("seq", F.greatest("sample_count", F.lit(1)))
    done = {c: F.col(c) for c in ("trip_id", "distance_m", "duration_s")}
    return _event(first, "trip.started", "started_at", {"trip_id": F.col("trip_id")}, "start_lat", "start_lon").unionByName(
        _event(last, "trip.ended", "ended_at", done, "end_lat", "end_lon")
    )


def marker_events(markers: DataFrame) -> DataFrame:
    """Markers the device set itself (event_type, lat_e7, lon_e7, note); 0/0 means no position."""
    known = (F.col("lat_e7") != 0) | (F.col("lon_e7") != 0)
    rows = markers.withColumns(
        {"_lat": F.when(known, F.col("lat_e7") / 1e7), "_lon": F.when(known, F.col("lon_e7") / 1e7)}
    )
    detail = {"event_type": F.col("event_type"), "event_type_name": trip_event(F.col("event_type")), "detail": F.col("note")}
    return _event(rows, "device.marker", "observed_at", detail, "_lat", "_lon")


def bundle_events(t: Tables, trips: DataFrame | None = None) -> DataFrame:
    """All derived events."""
    return sample_events(t).unionByName(trip_events(bundle_trips(t) if trips is None else trips))


def merge_events(old: DataFrame, new: DataFrame) -> DataFrame:
    """New events over old ones by event_id; what was already published stays marked as such."""
    cols = [c for c in new.columns if c != "event_id"]
    renamed = new.select("event_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in cols])
    merged = old.join(renamed, "event_id", "full")
    return merged.select(
        "event_id", *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in cols], "published_at"
    )


def merge_trips(old: DataFrame, new: DataFrame) -> DataFrame:
    """Trips of the new run replace those of the same trip_id."""
    return old.join(new.select("trip_id"), "trip_id", "left_anti").unionByName(new)


def gap_rows(t: Tables, trips: DataFrame) -> DataFrame:
    """Gaps with the trip of their bundle and the cause by name."""
    return t.gap.join(trips.select("content_root", "trip_id"), ROOT, "left").select(
        "content_root", "seq", "vehicle_id", "trip_id", "started_at", "duration_ms", gap_cause(F.col("cause")).alias("cause_name")
    )


DAY = ["vehicle_id", "device_id", "day"]


def daily_rollups(trips: DataFrame, events: DataFrame) -> DataFrame:
    """Totals per vehicle, device and UTC day that has a trip. ``events`` carries device_id."""
    driven = trips.groupBy("vehicle_id", "device_id", F.col("started_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("trip_count"),
        F.coalesce(F.sum("distance_m"), F.lit(0.0)).alias("distance_m"),
        F.coalesce(F.sum("duration_s"), F.lit(0)).alias("duration_s"),
        F.max("max_speed_mps").alias("max_speed_mps"),
        F.coalesce(F.sum("gap_duration_s"), F.lit(0)).alias("gap_duration_s"),
    )
    happened = events.groupBy("vehicle_id", "device_id", F.col("occurred_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("event_count")
    )
    return driven.join(happened, DAY, "left").withColumn("event_count", F.coalesce("event_count", F.lit(0)))


def refresh_rollups(rollups: DataFrame, trips: DataFrame, events: DataFrame, changed: DataFrame) -> DataFrame:
    """Recompute only the days that ``changed`` trips start on; other days keep their row."""
    days = settle(changed.select("vehicle_id", "device_id", F.col("started_at").cast("date").alias("day")).distinct())

    def of_days(rows: DataFrame, at: str) -> DataFrame:
        return rows.withColumn("day", F.col(at).cast("date")).join(days, DAY, "left_semi").drop("day")

    fresh = daily_rollups(of_days(trips, "started_at"), of_days(events, "occurred_at"))
    return rollups.join(days, DAY, "left_anti").unionByName(fresh)


# --- bundle summaries -------------------------------------------------------------------------


def health_summary(status: DataFrame) -> DataFrame:
    """Health records per bundle: how many, how many degraded, and every state that was set."""
    return status.groupBy(*ROOT).agg(
        F.count(F.lit(1)).alias("health_records"),
        F.count_if(F.col("health_state") != 0).alias("degraded"),
        F.coalesce(F.bit_or("health_state"), F.lit(0)).alias("states"),
    ).withColumn("state_names", health_names(F.col("states")))


def event_tally(markers: DataFrame) -> DataFrame:
    """Device markers per bundle by type name."""
    return markers.groupBy(*ROOT, trip_event(F.col("event_type")).alias("event_name")).agg(F.count(F.lit(1)).alias("n"))


def boost_summary(boost: DataFrame) -> DataFrame:
    """Peak boost per bundle, the mixture in that very reading, and the range of the trims."""
    peak = F.max_by(
        F.struct("boost_psi", "lambda_ratio"),
        F.when(F.col("boost_psi").isNotNull(), F.struct(F.col("boost_psi"), (-F.col("seq")).alias("s"))),
    )
    return boost.groupBy(*ROOT).agg(
        peak.alias("peak"),
        *[f(c).alias(f"{c}_{n}") for c in ("stft_pct", "ltft_pct") for n, f in (("min", F.min), ("max", F.max))],
        F.count_if(F.col("pids_answered") > 0).alias("answered"),
        F.count(F.lit(1)).alias("total"),
    ).select(
        "content_root", F.col("peak.boost_psi").alias("peak_boost_psi"), F.col("peak.lambda_ratio").alias("lambda_at_peak"),
        "stft_pct_min", "stft_pct_max", "ltft_pct_min", "ltft_pct_max", "answered", "total",
    )
