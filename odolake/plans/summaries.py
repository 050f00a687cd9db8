"""Plain aggregations: vehicles, boots, bundles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT, from_device, from_phone
from odolake.sources.tables import Tables


def v_reproducibility(t: Tables) -> DataFrame:
    """Per bundle: decoder, digest and whether a second decode agreed."""
    return t.bundles.select(
        "vehicle_id", "content_root", "origin", "decoder_ver", "output_digest", "reproduced",
        *[f"n_{k}" for k in ("position", "imu", "obd", "boost", "status", "transition", "gap")], "warnings",
    )


def v_vehicles(t: Tables) -> DataFrame:
    """Vehicles with bundles; one without samples keeps its row."""
    seen = [t[n].select("vehicle_id", "observed_at") for n in ("position", "obd", "imu", "status")]
    span = (
        reduce(DataFrame.unionByName, seen)
        .groupBy("vehicle_id")
        .agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"))
    )
    held = t.bundles.groupBy("vehicle_id").agg(
        F.count(F.lit(1)).alias("bundles"), F.count_distinct("boot_id").alias("boots")
    )
    return held.join(span, "vehicle_id", "left")


def v_drive_summary(t: Tables) -> DataFrame:
    """One row per boot that has engine polls."""
    drive = t.obd.groupBy(*BOOT).agg(
        ((F.max("mono_ms") - F.min("mono_ms")) / 1000.0).alias("duration_s"),
        F.max("speed_kph").alias("max_speed_kph"),
        F.max("rpm").alias("max_rpm"),
        F.count(F.lit(1)).alias("obd_samples"),
    )
    fixes = t.position.groupBy(*BOOT).agg(
        F.count_if(from_device()).alias("gnss_samples"),
        F.count_if(from_device() & (F.col("fix_type") > 0)).alias("fix_samples"),
        F.count_if(from_phone()).alias("phone_samples"),
    )
    gaps = t.gap.groupBy(*BOOT).agg(
        F.count(F.lit(1)).alias("gap_count"),
        F.sum("duration_ms").alias("gap_duration_ms"),
        F.max("duration_ms").alias("max_gap_ms"),
    )
    notes = t.bundles.groupBy(*BOOT).agg(joined_distinct(F.when(F.col("warnings") != "", F.col("warnings")), "; ").alias("warnings"))
    counts = ["gnss_samples", "fix_samples", "phone_samples", "gap_count", "gap_duration_ms", "max_gap_ms"]
    return (
        drive.join(fixes, BOOT, "left")
        .join(gaps, BOOT, "left")
        .join(notes, BOOT, "left")
        .select(
            *drive.columns, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in counts], "warnings"
        )
    )


def joined_distinct(col, sep: str):
    """Distinct values in order, joined; NULL when there is none."""
    return F.nullif(F.array_join(F.array_sort(F.collect_set(col)), sep), F.lit(""))


def v_boot_start(t: Tables) -> DataFrame:
    """First dated engine or boost sample of each boot."""
    both = t.boost.select(*BOOT, "observed_at").unionByName(t.obd.select(*BOOT, "observed_at"))
    return both.where("observed_at IS NOT NULL").groupBy(*BOOT).agg(F.min("observed_at").alias("started_at"))
