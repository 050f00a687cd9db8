"""Places from Wi-Fi: where access points are, where unfixed scans were, and the anchors a device may carry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT, SCAN_LEARNING, from_device, has_bit
from odolake.functions.geo import METRES_PER_DEGREE
from odolake.operators.asof import Side, asof
from odolake.operators.topk import first_rows
from odolake.plans.trusted import v_position_trusted
from odolake.session import settle
from odolake.sources.tables import Tables

BESIDE_FIX_MS = 2000
SLOW_MPS = 20
MIN_SIGHTINGS = 2
MAX_SPREAD_M = 300
UNFIXED_MS = 5000
ESTIMATE_PAD_M = 25
MIN_ACCURACY_M = 25
MAX_ACCURACY_M = 500
PLACE = ["vehicle_id", "bssid"]


def signal_weight(rssi: Column) -> Column:
    return F.pow(F.lit(10.0), rssi / 20.0)


def v_wifi_ap_learned(t: Tables, trusted: DataFrame | None = None) -> DataFrame:
    """Signal-weighted place of each access point from learning scans beside a trusted device fix."""
    trusted = v_position_trusted(t) if trusted is None else trusted
    learning = t.wifi_scan.where(has_bit("flags", SCAN_LEARNING)).select(*BOOT, "seq")
    heard = t.wifi_ap_obs.select(*BOOT, "mono_ms", "seq", "observed_at", "bssid", "rssi_dbm").join(
        learning, [*BOOT, "seq"]
    )
    fixes = trusted.where(F.col("trusted") & from_device())
    side = Side("f", fixes, ["lat", "lon", "speed_mps"], within=BESIDE_FIX_MS)
    placed = asof(heard, [side], BOOT).where(F.col("f").isNotNull() & (F.coalesce("f.speed_mps", F.lit(0.0)) < SLOW_MPS))
    placed = placed.select(*PLACE, "rssi_dbm", "observed_at", "f.lat", "f.lon", signal_weight(F.col("rssi_dbm")).alias("w"))
    return places(placed)


def places(placed: DataFrame) -> DataFrame:
    """Centre and spread of each place from its sightings (lat, lon, w, rssi_dbm, observed_at) in one aggregation.

    The mean square distance from the weighted centre is the variance plus the square of what lies between the plain mean
    and that centre, so sums, means and central moments, all of which merge, are enough and no sighting is met twice.
    """
    w = F.sum("w")
    moments = placed.groupBy(*PLACE).agg(
        (F.sum(F.col("lat") * F.col("w")) / w).alias("c_lat"), (F.sum(F.col("lon") * F.col("w")) / w).alias("c_lon"),
        *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("mean", F.avg), ("var", F.var_pop))],
        F.count(F.lit(1)).alias("observations"), F.max("rssi_dbm").alias("max_rssi_dbm"),
        F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"),
    )
    square = {c: F.col(f"var_{c}") + F.pow(F.col(f"mean_{c}") - F.col(f"c_{c}"), F.lit(2)) for c in ("lat", "lon")}
    spread = METRES_PER_DEGREE * F.sqrt(square["lat"] + square["lon"] * F.pow(F.cos(F.radians("c_lat")), F.lit(2)))
    found = moments.withColumn("spread_m", spread).where((F.col("observations") >= MIN_SIGHTINGS) & (F.col("spread_m") <= MAX_SPREAD_M))
    return found.select(
        *PLACE, F.col("c_lat").alias("lat"), F.col("c_lon").alias("lon"), "observations", "spread_m", "max_rssi_dbm",
        "first_seen", "last_seen",
    )


def v_wifi_scan_unfixed(t: Tables, trusted: DataFrame | None = None) -> DataFrame:
    """Scans with no trusted fix of any source within 5 s, and an estimate where access points are known."""
    if trusted is None:
        trusted = settle(
            v_position_trusted(t).where("trusted").select(
                *BOOT, "mono_ms", "seq", "lat", "lon", "speed_mps", "source_flags", "trusted"
            )
        )
    fixes = trusted.where("trusted")
    scans = t.wifi_scan.select(*BOOT, "mono_ms", "seq", "observed_at", "ap_count")
    sides = [Side("b", fixes, [], within=UNFIXED_MS), Side("a", fixes, [], forward=True, within=UNFIXED_MS)]
    unfixed = asof(scans, sides, BOOT).where("b IS NULL AND a IS NULL").drop("a", "b")
    learned = v_wifi_ap_learned(t, trusted).select(*PLACE, "lat", "lon", "spread_m")
    w = signal_weight(F.col("rssi_dbm"))
    estimate = (
        t.wifi_ap_obs.select(*BOOT, "seq", "bssid", "rssi_dbm")
        .join(learned, PLACE)
        .groupBy(*BOOT, "seq")
        .agg(
            (F.sum(F.col("lat") * w) / F.sum(w)).alias("est_lat"),
            (F.sum(F.col("lon") * w) / F.sum(w)).alias("est_lon"),
            (F.avg("spread_m") + ESTIMATE_PAD_M).alias("est_accuracy_m"),
            F.count(F.lit(1)).cast("int").alias("est_aps"),
        )
    )
    return unfixed.join(estimate, [*BOOT, "seq"], "left").select(
        *scans.columns, "est_lat", "est_lon", "est_accuracy_m", "est_aps"
    )


def wifi_anchors(learned: DataFrame, fitted: DataFrame, limit: int | None = None) -> DataFrame:
    """The access points each device may carry: best row per address over its open vehicles.

    With ``limit``, the best so many of a device; a device's addresses are never ranked all together.
    ``fitted`` has device_id and vehicle_id of open assignments.
    """
    lat, lon = F.col("lat"), F.col("lon")
    usable = learned.where(
        F.lower("bssid").rlike("^([0-9a-f]{2}:){5}[0-9a-f]{2}$")
        & lat.between(-90, 90)
        & lon.between(-180, 180)
        & ~((lat == 0) & (lon == 0))
    )
    usable = usable.select(
        "vehicle_id", F.lower("bssid").alias("bssid"), "lat", "lon", "observations",
        F.coalesce("spread_m", F.lit(0.0)).alias("spread_m"),
        F.coalesce("max_rssi_dbm", F.lit(-128)).alias("max_rssi_dbm"), "last_seen",
    )
    pairs = fitted.select("device_id", F.lower("vehicle_id").alias("vehicle_id")).distinct()
    rows = usable.join(pairs, "vehicle_id")
    rank = F.struct("observations", "max_rssi_dbm", (-F.col("spread_m")).alias("tight"))
    best = rows.groupBy("device_id", "bssid").agg(
        F.max_by(F.struct("lat", "lon", "observations", "spread_m", "max_rssi_dbm", "last_seen"), rank).alias("r")
    )
    best = best.select("device_id", "bssid", "r.*")
    kept = best
    if limit is not None:
        order = [F.desc("observations"), F.desc("max_rssi_dbm"), F.asc("spread_m"), F.asc("bssid")]
        kept = first_rows(best, ["device_id"], order, limit)
    accuracy = F.ceil(F.greatest("spread_m", F.lit(0.0)) + ESTIMATE_PAD_M)
    return kept.withColumn(
        "accuracy_m", F.greatest(F.least(accuracy, F.lit(MAX_ACCURACY_M)), F.lit(MIN_ACCURACY_M)).cast("int")
    )
