"""What a tune changed and whether the car is well: metric samples, before/after, recent against baseline, findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from odolake.functions.flags import BOOT
from odolake.functions.sentences import fill, shown, template_rows
from odolake.operators.asof import Side, asof
from odolake.operators.medians import medians
from odolake.plans.engine import v_pulls
from odolake.plans.summaries import v_boot_start
from odolake.session import settle
from odolake.sources.tables import Tables

CORE_METRICS = ("boost_psi", "lambda", "ltft_pct", "stft_pct")
FEW_READINGS = 20
RECENT_DAYS = 14
#: Width in microseconds of the slices in which samples and tunes are matched: thirty days.
TUNE_SLICE = 30 * 86_400_000_000


def v_metric_samples(t: Tables, extra_arms: Sequence[DataFrame] = ()) -> DataFrame:
    """One observation per row: a pull's peak boost and mean lambda, a boot's median trims.

    A trim is a whole number of percent in one byte, so a boot's median works on at
    most 256 distinct values.
    """
    started = v_boot_start(t)
    pulls = v_pulls(t).select(
        *BOOT,
        F.explode(
            F.array(
                F.struct(F.lit("boost_psi").alias("metric"), F.col("peak_boost_psi").alias("value")),
                F.struct(F.lit("lambda").alias("metric"), F.col("avg_lambda").alias("value")),
            )
        ).alias("m"),
    )
    pulls = pulls.select(*BOOT, "m.metric", "m.value").where("value IS NOT NULL")
    trims = t.boost.groupBy(*BOOT).agg(
        *[F.median(c).alias(c) for c in ("ltft_pct", "stft_pct")],
        *[F.count(c).alias(f"n_{c}") for c in ("ltft_pct", "stft_pct")],
    )
    trims = trims.select(
        *BOOT,
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"), F.col(f"n_{c}").alias("n"))
                    for c in ("ltft_pct", "stft_pct")
                ]
            )
        ).alias("m"),
    )
    trims = trims.where(F.col("m.n") >= FEW_READINGS).select(*BOOT, "m.metric", "m.value")
    dated = pulls.unionByName(trims).join(started, BOOT)
    return reduce(DataFrame.unionByName, extra_arms, dated.select(*BOOT, "metric", "value", "started_at"))


def v_tune_effect(t: Tables, samples: DataFrame | None = None, metrics: Sequence[str] = CORE_METRICS) -> DataFrame:
    """Medians under the previous tune and under this one; every tune has a row per metric.

    A car's tunes are a step function of time: a sample falls on one step, which is after the tune that began it and before the
    tune that ends it. So an as-of match sends each sample to two tunes at most, however many the car had.
    """
    samples = settle(v_metric_samples(t)) if samples is None else samples
    tunes = t.tune.where("vehicle_id IS NOT NULL").select("vehicle_id", "tune_id", "tuned_at")
    # Of tunes at the same instant the first ends the step before, the last begins the one after.
    at = F.unix_micros(F.col("tuned_at").cast("timestamp"))
    steps = settle(tunes.groupBy("vehicle_id", at.alias("_at")).agg(F.min("tune_id").alias("first"), F.max("tune_id").alias("last")))
    steps = steps.withColumn("seq", F.lit(0).cast("long"))
    placed = samples.where("vehicle_id IS NOT NULL").withColumn("_at", F.unix_micros(F.col("started_at").cast("timestamp")))
    ends = steps.withColumn("_at", F.col("_at") - 1)  # a sample at the very instant of a tune is after it
    sides = [Side("began", steps, ["last"]), Side("ends", ends, ["first"], forward=True)]
    stepped = asof(placed.where("_at IS NOT NULL"), sides, ["vehicle_id"], on="_at", width=TUNE_SLICE)
    of = F.array(
        F.struct(F.col("began.last").alias("tune_id"), F.lit("after").alias("side")), F.struct(F.col("ends.first").alias("tune_id"), F.lit("before").alias("side"))
    )
    sided = stepped.withColumn("_of", F.explode(of)).select("vehicle_id", "metric", "value", "_of.*").where("tune_id IS NOT NULL")
    key = ["vehicle_id", "tune_id", "metric"]
    found = _two_sided(sided, key, ("before", "after"))
    listed = tunes.select("vehicle_id", "tune_id", F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"))
    counts = [F.coalesce(f"{s}_n", F.lit(0)).cast("long").alias(f"{s}_n") for s in ("before", "after")]
    return listed.join(found, key, "left").select(*key, "before_median", "after_median", *counts)


def _two_sided(rows: DataFrame, key: Sequence[str], sides: Sequence[str]) -> DataFrame:
    found = medians(rows.where(F.col("side").isNotNull()), [*key, "side"], "value")
    return found.groupBy(*key).agg(
        *[F.max(F.when(F.col("side") == s, F.col("median"))).alias(f"{s}_median") for s in sides],
        *[F.max(F.when(F.col("side") == s, F.col("n"))).alias(f"{s}_n") for s in sides],
    )


def v_health_stats(t: Tables, samples: DataFrame | None = None) -> DataFrame:
    """The last 14 days of a car's own data against the stretch before them, since its latest tune."""
    samples = settle(v_metric_samples(t)) if samples is None else samples
    last = samples.groupBy("vehicle_id").agg(F.max("started_at").alias("last_observed_at"))
    tuned = t.tune.groupBy("vehicle_id").agg(F.max("tuned_at").alias("tuned_at"))
    about = last.join(tuned, "vehicle_id", "left")
    at = F.col("started_at")
    edge = F.col("last_observed_at") - F.expr(f"INTERVAL '{RECENT_DAYS}' DAY")
    since = F.coalesce(F.col("tuned_at"), F.lit("1970-01-01").cast("timestamp_ntz"))
    sided = samples.join(about, "vehicle_id").withColumn(
        "side", F.when(at > edge, "recent").when(at >= since, "baseline")
    )
    key = ["vehicle_id", "metric"]
    found = _two_sided(sided, key, ("recent", "baseline"))
    listed = samples.select(*key).distinct().join(about, "vehicle_id")
    sides = ("recent", "baseline")
    return listed.join(found, key, "left").select(
        *key,
        *[F.col(f"{s}_median") for s in sides],
        *[F.coalesce(f"{s}_n", F.lit(0)).cast("long").alias(f"{s}_n") for s in sides],
        "last_observed_at",
        "tuned_at",
    )


def health_findings(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """A verdict and a plain sentence per vehicle and metric, from limits of the vehicle's engine profile.

    ``limits`` has one row per vehicle and metric: has_signal, label, min, max,
    warn_low, warn_high, check_low, check_high, min_observations, drift_watch,
    drift_check. Where two verdicts apply the more serious one stands; where
    nothing is known there is no row.
    """
    known = stats.where(F.col("metric").isin(*CORE_METRICS)).join(limits, ["vehicle_id", "metric"])
    known = known.where(F.col("recent_median").isNotNull() & (F.col("recent_n") >= F.col("min_observations")))
    v, base, metric = F.col("recent_median"), F.col("baseline_median"), F.col("metric")
    has = F.col("has_signal")
    outside = has & ((v < F.col("min")) | (v > F.col("max")))
    stated = F.coalesce("warn_low", "warn_high", "check_low", "check_high").isNotNull()
    step = (
        F.when(outside, "outside")
        .when(~has | ~stated, None)
        .when(v > F.col("check_high"), "check_high")
        .when(v < F.col("check_low"), "check_low")
        .when(v > F.col("warn_high"), "warn_high")
        .when(v < F.col("warn_low"), "warn_low")
        .otherwise("normal")
    )
    trim = metric.isin("ltft_pct", "stft_pct")
    compared = trim & base.isNotNull() & (F.col("baseline_n") >= F.col("min_observations"))
    size = F.abs(v - base)
    drift = F.when(compared & (size >= F.col("drift_check")), "check").when(
        compared & (size >= F.col("drift_watch")), "watch"
    )
    level = F.when(F.col("_step").isin("outside", "check_high", "check_low"), 2).when(
        F.col("_step").isin("warn_high", "warn_low"), 1
    ).when(F.col("_step") == "normal", 0)
    drift_level = F.when(F.col("_drift") == "check", 2).when(F.col("_drift") == "watch", 1)
    judged = known.withColumns({"_step": step, "_drift": drift, "_compared": F.coalesce(compared, F.lit(False))})
    judged = judged.withColumn("_level", level).withColumn("_drift_level", drift_level)
    by_drift = F.col("_drift_level").isNotNull() & (
        F.col("_level").isNull() | (F.col("_drift_level") > F.col("_level"))
    )
    kind = (
        F.when(by_drift, F.when(v < base, "drift_less").otherwise("drift_more"))
        .when(F.col("_step").isNotNull(), F.col("_step"))
        .when(F.col("_compared"), "steady")
    )
    rank = F.when(by_drift, F.col("_drift_level")).otherwise(F.coalesce("_level", F.lit(0)))
    judged = judged.select("*", kind.alias("kind"), rank.cast("int").alias("rank")).where("kind IS NOT NULL")
    # A template per kind, metric and rank: a fixed handful of rows.
    worded = judged.join(F.broadcast(template_rows(stats.sparkSession)), ["kind", "metric", "rank"])
    limit = F.coalesce(
        *[F.when(F.col("kind") == k, F.col(k)) for k in ("check_high", "check_low", "warn_high", "warn_low")]
    )
    words = {
        "value": shown(metric, v),
        "limit": shown(metric, limit),
        "base": shown(metric, base),
        "since": F.when(F.col("tuned_at").isNotNull(), "since the last tune").otherwise("before"),
    }
    return worded.select(
        "vehicle_id",
        "metric",
        F.element_at(F.array(F.lit("ok"), F.lit("watch"), F.lit("check")), F.col("rank") + 1).alias("status"),
        fill(F.col("template"), words).alias("sentence"),
    )
