"""Views anchored on engine polls: telemetry, trim map, boost curve, speed agreement, pulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT, from_device, from_phone
from odolake.operators.asof import MINUTE_MS, Side, asof
from odolake.operators.spans import points_in_spans
from odolake.sources.tables import Tables

KPH_PER_MPS = 3.6
MAP_CEILING_KPA = 255
FRESH_BOOST_MS = 2000
FRESH_FIX_MS = 5000
SAME_FIX_MS = 500
WIDE_OPEN_PCT = 70
PULL_RPM_RISE = 500


def _unsaturated(col: str = "map_kpa"):
    return F.col(col).isNull() | (F.col(col) < MAP_CEILING_KPA)


def v_telemetry(t: Tables) -> DataFrame:
    """Each engine poll with the latest boost reading and device fix at or before it, and their ages."""
    polls = t.obd.select(
        *BOOT, "mono_ms", "seq", "observed_at", "speed_kph", "rpm", "throttle_pct", "load_pct", "coolant_c",
        "intake_c", "timing_advance_deg",
    )
    boost = Side("b", t.boost, ["boost_psi", "map_kpa", "baro_kpa", "lambda_ratio", "stft_pct", "ltft_pct", "maf_cgps"])
    fix = Side("p", t.position, ["speed_mps", "lat", "lon", "fix_type"], where=from_device())
    matched = asof(polls, [boost, fix], BOOT)
    return matched.select(
        *[c for c in polls.columns if c != "seq"],
        *[F.col(f"b.{c}") for c in boost.cols],
        (F.col("mono_ms") - F.col("b.mono_ms")).alias("boost_age_ms"),
        (F.col("p.speed_mps") * KPH_PER_MPS).alias("gnss_speed_kph"),
        *[F.col(f"p.{c}") for c in ("lat", "lon", "fix_type")],
        (F.col("mono_ms") - F.col("p.mono_ms")).alias("gnss_age_ms"),
    )


def _with_fresh_boost(t: Tables, poll_cols: list[str], boost_cols: list[str]) -> DataFrame:
    polls = t.obd.select(*BOOT, "mono_ms", "seq", *poll_cols)
    matched = asof(polls, [Side("b", t.boost, boost_cols, within=FRESH_BOOST_MS)], BOOT)
    age = F.col("mono_ms") - F.col("b.mono_ms")
    return matched.withColumn("boost_age_ms", age).where(age < FRESH_BOOST_MS)


def v_trim_map(t: Tables) -> DataFrame:
    """Mean fuel trims per boot, 500 rpm bin and 10 % load bin, from boost readings under 2 s old."""
    fresh = _with_fresh_boost(t, ["rpm", "load_pct"], ["stft_pct", "ltft_pct"])
    usable = fresh.where("rpm IS NOT NULL AND load_pct IS NOT NULL AND b.stft_pct IS NOT NULL")
    return usable.groupBy(
        *BOOT, F.expr("rpm div 500 * 500").alias("rpm_bin"), F.expr("load_pct div 10 * 10").alias("load_bin")
    ).agg(
        F.avg("b.stft_pct").alias("avg_stft"), F.avg("b.ltft_pct").alias("avg_ltft"), F.count(F.lit(1)).alias("samples")
    )


def v_boost_curve(t: Tables) -> DataFrame:
    """Boost against rpm; a saturated reading drops its poll rather than falling back to an older one."""
    fresh = _with_fresh_boost(t, ["rpm"], ["boost_psi", "map_kpa", "baro_kpa"])
    usable = fresh.where(F.col("rpm").isNotNull() & F.col("b.boost_psi").isNotNull() & _unsaturated("b.map_kpa"))
    return usable.select(*BOOT, "mono_ms", "rpm", "b.boost_psi", "b.map_kpa", "b.baro_kpa", "boost_age_ms")


def v_speed_agreement(t: Tables) -> DataFrame:
    """Wheel speed against the latest device fix under 5 s old."""
    polls = t.obd.select(*BOOT, "mono_ms", "seq", "speed_kph").where("speed_kph IS NOT NULL")
    side = Side("p", t.position, ["speed_mps", "fix_type"], within=FRESH_FIX_MS, where=from_device())
    age = F.col("mono_ms") - F.col("p.mono_ms")
    gnss = F.col("p.speed_mps") * KPH_PER_MPS
    matched = asof(polls, [side], BOOT).where(
        F.col("p.speed_mps").isNotNull() & (F.col("p.fix_type") > 0) & (age < FRESH_FIX_MS)
    )
    return matched.select(
        *BOOT,
        "mono_ms",
        F.col("speed_kph").alias("obd_speed_kph"),
        gnss.alias("gnss_speed_kph"),
        F.when((F.col("speed_kph") > 5) & (gnss > 5), F.col("speed_kph") / gnss).alias("ratio"),
        age.alias("gnss_age_ms"),
    )


def v_gnss_sources(t: Tables) -> DataFrame:
    """Device fixes beside the latest phone fix, where both hold a fix less than 500 ms apart."""
    cols = ["lat", "lon", "fix_type", "h_acc_m", "speed_mps"]
    device = t.position.where(from_device() & (F.col("fix_type") > 0)).select(*BOOT, "mono_ms", "seq", *cols)
    side = Side("p", t.position, cols, within=SAME_FIX_MS, where=from_phone())
    apart = F.abs(F.col("mono_ms") - F.col("p.mono_ms"))
    matched = asof(device, [side], BOOT).where((F.col("p.fix_type") > 0) & (apart < SAME_FIX_MS))
    names = ["lat", "lon", "fix", "hacc", "speed"]
    return matched.select(
        *BOOT,
        "mono_ms",
        *[F.col(c).alias(f"internal_{n}") for c, n in zip(cols, names, strict=True)],
        *[F.col(f"p.{c}").alias(f"phone_{n}") for c, n in zip(cols, names, strict=True)],
        apart.alias("time_offset_ms"),
    )


def v_pulls(t: Tables) -> DataFrame:
    """Runs of wide-open throttle with a real rise in rpm, and the boost readings inside each.

    A run is named by the last poll before it that was not wide open, which is an
    as-of match: no numbering of a whole boot is needed.
    """
    polls = t.obd.where("throttle_pct IS NOT NULL AND rpm IS NOT NULL").select(
        *BOOT, "mono_ms", "seq", "rpm", "throttle_pct", "load_pct", "speed_kph"
    )
    wide_open = polls.where(F.col("throttle_pct") >= WIDE_OPEN_PCT)
    breaks = polls.where(F.col("throttle_pct") < WIDE_OPEN_PCT)
    placed = asof(wide_open, [Side("brk", breaks, ["seq"])], BOOT, strict_order=True)
    runs = (
        placed.groupBy(*BOOT, F.col("brk.mono_ms").alias("_brk_ms"), F.col("brk.seq").alias("_brk_seq"))
        .agg(
            F.min("mono_ms").alias("start_ms"),
            F.max("mono_ms").alias("end_ms"),
            F.min("rpm").alias("min_rpm"),
            F.max("rpm").alias("max_rpm"),
            F.max("speed_kph").alias("max_speed_kph"),
            F.avg("load_pct").alias("avg_load"),
            F.count(F.lit(1)).alias("obd_samples"),
        )
        .where((F.col("max_rpm") > F.col("min_rpm") + PULL_RPM_RISE) & (F.col("obd_samples") >= 2))
        .drop("_brk_ms", "_brk_seq")
    )
    readings = t.boost.where(_unsaturated()).select(
        *BOOT, "mono_ms", "boost_psi", "lambda_ratio", "stft_pct", "ltft_pct"
    )
    spans = runs.select(*BOOT, "start_ms", "end_ms")
    held = points_in_spans(readings, "mono_ms", spans, "start_ms", "end_ms", BOOT, MINUTE_MS)
    stats = held.groupBy(*BOOT, "start_ms", "end_ms").agg(
        F.max("boost_psi").alias("peak_boost_psi"),
        F.avg("lambda_ratio").alias("avg_lambda"),
        F.avg("stft_pct").alias("avg_stft"),
        F.avg("ltft_pct").alias("avg_ltft"),
    )
    return runs.join(stats, [*BOOT, "start_ms", "end_ms"], "left").select(
        *BOOT,
        "start_ms",
        "end_ms",
        ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_s"),
        "min_rpm",
        "max_rpm",
        "max_speed_kph",
        "avg_load",
        "obd_samples",
        "peak_boost_psi",
        "avg_lambda",
        "avg_stft",
        "avg_ltft",
    )
