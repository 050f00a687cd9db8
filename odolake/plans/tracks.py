"""The drawn track of a trip: points, runs, gaps and encoded lines, for any number of trips at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.functions.polyline import encoded_step
from odolake.functions.timecols import millis
from odolake.operators.slices import neighbour, row_numbers, running, slice_of
from odolake.operators.spans import points_in_spans

RUN_BREAK_MS = 30_000
POINTS_PER_SLICE = 4096
MINUTE_MS = 60_000
HOUR_MS = 3_600_000


def track_points(trusted: DataFrame, trips: DataFrame, max_points: int | None = None) -> DataFrame:
    """Device fixes of each trip in time order, numbered, with the run each belongs to.

    ``trips`` holds vehicle_id, trip_id, started_at and ended_at. A fix whose source
    is unknown is left out here: only a known device fix is drawn. With ``max_points`` a
    longer trip is thinned evenly to about so many points, its last one included.
    """
    spans = trips.select("vehicle_id", "trip_id", millis("started_at").alias("lo"), millis("ended_at").alias("hi"))
    fixes = trusted.where(
        (F.col("source_flags").bitwiseAND(32) == 0)
        & F.col("lat").isNotNull()
        & F.col("lon").isNotNull()
        & F.col("observed_at").isNotNull()
    ).select("vehicle_id", millis("observed_at").alias("at_ms"), "mono_ms", "seq", "lat", "lon")
    placed = points_in_spans(fixes, "at_ms", spans, "lo", "hi", ["vehicle_id"], HOUR_MS).drop("lo", "hi")
    key = ["vehicle_id", "trip_id"]
    numbered = row_numbers(placed, key, ["at_ms", "mono_ms", "seq"], "at_ms", MINUTE_MS, "n")
    thinned = F.lit(False)
    if max_points is not None:
        sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
        stride = F.greatest(F.ceil(F.col("total") / F.lit(max_points)).cast("long"), F.lit(1))
        numbered = numbered.join(sizes, key).where(((F.col("n") - 1) % stride == 0) | (F.col("n") == F.col("total")))
        thinned = F.col("total") > max_points
    marked = neighbour(numbered, key, ["n"], "n", POINTS_PER_SLICE, ["at_ms"], "_prev").withColumn("prev_at_ms", F.col("_prev.at_ms"))
    breaks = F.when(F.col("at_ms") - F.col("prev_at_ms") > RUN_BREAK_MS, 1).otherwise(0)
    runs = running(marked, key, ["n"], "n", POINTS_PER_SLICE, {"run_no": ("sum", breaks.cast("long"))})
    return runs.withColumn("thinned", thinned).select(*key, "n", "at_ms", "lat", "lon", "run_no", "prev_at_ms", "thinned")


def track_lines(points: DataFrame) -> DataFrame:
    """Encoded lines in parts of at most ``POINTS_PER_SLICE`` points: span, point count and text of each.

    The parts of a run, put together in order of ``part``, are its encoded line.
    """
    key = ["vehicle_id", "trip_id", "run_no"]

    def scaled(col):
        return F.round(F.col(col) * 1e5).cast("long")

    whole = points.withColumn("_lat", scaled("lat")).withColumn("_lon", scaled("lon"))
    placed = neighbour(whole, key, ["n"], "n", POINTS_PER_SLICE, ["_lat", "_lon"], "_prev")
    step = [encoded_step(F.col(c) - F.coalesce(F.col(f"_prev.{c}"), F.lit(0))) for c in ("_lat", "_lon")]
    coded = placed.withColumn("_code", F.concat(*step)).withColumn("part", slice_of("n", POINTS_PER_SLICE))
    return coded.groupBy(*key, "part").agg(
        F.min("at_ms").alias("started_ms"),
        F.max("at_ms").alias("ended_ms"),
        F.count(F.lit(1)).alias("points"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("n", "_code"))), lambda p: p["_code"]), ""
        ).alias("polyline"),
    )


def track_runs(points: DataFrame) -> DataFrame:
    """One row per unbroken run: span, point count and encoded line, its parts put together.

    The line of a run is one value; where runs have no bound, use ``track_lines``.
    """
    key = ["vehicle_id", "trip_id", "run_no"]
    return track_lines(points).groupBy(*key).agg(
        F.min("started_ms").alias("started_ms"),
        F.max("ended_ms").alias("ended_ms"),
        F.sum("points").alias("points"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("part", "polyline"))), lambda p: p["polyline"]), ""
        ).alias("polyline"),
    )


def track_gaps(points: DataFrame) -> DataFrame:
    """Breaks between consecutive runs."""
    return points.where(F.col("at_ms") - F.col("prev_at_ms") > RUN_BREAK_MS).select(
        "vehicle_id",
        "trip_id",
        F.col("prev_at_ms").alias("after_ms"),
        F.col("at_ms").alias("before_ms"),
        (F.col("at_ms") - F.col("prev_at_ms")).alias("duration_ms"),
    )
