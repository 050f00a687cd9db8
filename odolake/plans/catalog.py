"""All analysis views by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.functions.timecols import millis
from odolake.plans import bundle, engine, insight, modules, power, summaries, tracks, trips, trusted, wifi
from odolake.session import settle
from odolake.sources.tables import Tables


def lazily(df: DataFrame) -> DataFrame:
    return df


def _tracked(trip_rows: DataFrame) -> DataFrame:
    """Trips under the id that the change feed gives them."""
    entity = F.concat_ws(":", F.lower("vehicle_id"), millis("started_at").cast("string"))
    return trip_rows.select("vehicle_id", "started_at", "ended_at", entity.alias("trip_id"))


def views(
    t: Tables, mods: Sequence[modules.Module] = (), keep: Callable[[DataFrame], DataFrame] = lazily,
    limits: DataFrame | None = None, fitted: DataFrame | None = None,
) -> Tables:
    """Every view as a frame, built on first use.

    Findings need ``limits`` of the vehicles' engine profiles, anchors the open assignments ``fitted`` (device_id, vehicle_id);
    without them these two views are absent.

    Steps that several views share (trusted positions, metric samples, trips) go through ``keep``: by default nothing
    runs until a frame is read, and every view computes them for itself; with ``session.settle`` they are
    computed once, on shared storage, when a view that needs them is first built.
    """
    if mods:
        t = modules.apply_derivations(t, mods)

    def samples() -> DataFrame:
        arms = modules.metric_arms(mods, out.__getitem__, out["v_boot_start"]) if mods else ()
        return keep(insight.v_metric_samples(t, arms))

    def devices() -> DataFrame:
        return t.bundles.select("content_root", "device_id")

    keys = modules.metric_keys(mods)
    out = Tables(
        {
            **{n: (lambda n=n: t[n]) for n in t},
            "v_telemetry": lambda: engine.v_telemetry(t),
            "v_reproducibility": lambda: summaries.v_reproducibility(t),
            "v_vehicles": lambda: summaries.v_vehicles(t),
            "v_drive_summary": lambda: summaries.v_drive_summary(t),
            "v_position_trusted": lambda: keep(trusted.v_position_trusted(t)),
            "v_wifi_ap_learned": lambda: wifi.v_wifi_ap_learned(t, out["v_position_trusted"]),
            "v_wifi_scan_unfixed": lambda: wifi.v_wifi_scan_unfixed(t, out["v_position_trusted"]),
            "v_trip_leg": lambda: trips.v_trip_leg(t, out["v_position_trusted"]),
            "v_trip_summary": lambda: keep(trips.v_trip_summary(t, out["v_position_trusted"], keep=keep)),
            "v_trim_map": lambda: engine.v_trim_map(t),
            "v_boost_curve": lambda: engine.v_boost_curve(t),
            "v_pulls": lambda: engine.v_pulls(t),
            "v_speed_agreement": lambda: engine.v_speed_agreement(t),
            "v_gnss_sources": lambda: engine.v_gnss_sources(t),
            "v_boot_start": lambda: summaries.v_boot_start(t),
            "v_metric_samples": samples,
            "v_tune_effect": lambda: insight.v_tune_effect(t, out["v_metric_samples"], keys),
            "v_health_stats": lambda: insight.v_health_stats(t, out["v_metric_samples"]),
            "v_trip_period": lambda: trips.v_trip_period(out["v_trip_summary"]),
            "v_power_windows": lambda: power.power_windows(t),
            "v_power_summary": lambda: power.power_summary(t),
            "bundle_trips": lambda: keep(bundle.bundle_trips(t)),
            "trip_segments": lambda: bundle.trip_segments(t),
            "trip_events": lambda: keep(bundle.bundle_events(t, out["bundle_trips"]).join(devices(), "content_root", "left")),
            "trip_gaps": lambda: bundle.gap_rows(t, out["bundle_trips"]),
            "daily_rollups": lambda: bundle.daily_rollups(out["bundle_trips"], out["trip_events"]),
            "v_trip_publish": lambda: trips.trip_publish(out["v_trip_summary"]),
            "v_trip_track": lambda: keep(tracks.track_points(out["v_position_trusted"], _tracked(out["v_trip_summary"]))),
            "v_trip_track_runs": lambda: tracks.track_runs(out["v_trip_track"]),
            "v_trip_track_gaps": lambda: tracks.track_gaps(out["v_trip_track"]),
            **({} if limits is None else {"v_health_findings": lambda: insight.health_findings(out["v_health_stats"], limits)}),
            **({} if fitted is None else {"v_wifi_anchors": lambda: wifi.wifi_anchors(out["v_wifi_ap_learned"], fitted)}),
        }
    )
    return out


def register(
    spark: SparkSession, t: Tables, mods: Sequence[modules.Module] = (), keep: Callable[[DataFrame], DataFrame] = settle,
    limits: DataFrame | None = None, fitted: DataFrame | None = None,
) -> Tables:
    """Make the tables and views known to ``spark.sql``, and ``period_summary`` with them.

    What several views share is computed here, once; pass ``lazily`` to leave it to each query.
    """
    found = views(t, mods, keep, limits, fitted)
    for name in found:
        found[name].createOrReplaceTempView(name)
    trips.register_period_summary(spark)
    modules.register_module_views(spark, mods)
    return found
