"""Checks against the device and vehicle registry: bundle counters and assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odolake.operators.slices import neighbour, running

SLICE_ROWS = 65_536


def folded(rows: DataFrame, *ids: str) -> DataFrame:
    """Ids are compared without regard to case; those that are text are taken in lower case."""
    text = [f.name for f in rows.schema if f.name in ids and f.dataType == T.StringType()]
    return rows.withColumns({c: F.lower(c) for c in text}) if text else rows


def counter_verdicts(offers: DataFrame, arrival: str = "arrival") -> DataFrame:
    """new / duplicate / conflict per offer (device_id, counter, content_root) in arrival order.

    The first content offered under a counter owns it. A new counter past the
    device's high-water mark leaves a gap of the counters in between. Devices and contents are taken in lower case.
    """
    offers = folded(offers, "device_id", "content_root")
    key = ["device_id", "counter"]
    valid = offers.where("counter > 0")
    owner = valid.groupBy(*key).agg(F.min(F.struct(F.col(arrival).alias("n"), "content_root")).alias("own"))
    highs = running(
        offers, ["device_id"], [arrival], arrival, SLICE_ROWS,
        {"high_water": ("max", F.when(F.col("counter") > 0, F.col("counter")))}, exclusive=True,
    )
    rows = highs.join(owner, key, "left")
    verdict = (
        F.when(F.col("counter") == 0, "conflict")
        .when(F.col("own.n") == F.col(arrival), "new")
        .when(F.col("own.content_root") == F.col("content_root"), "duplicate")
        .otherwise("conflict")
    )
    high = F.coalesce("high_water", F.lit(0)).cast("long")
    rows = rows.withColumn("verdict", verdict).withColumn("high_water", high)
    skipped = F.when(F.col("verdict") == "new", F.greatest(F.col("counter") - F.col("high_water") - 1, F.lit(0))).otherwise(0)
    return rows.withColumn("gap", skipped.cast("long")).drop("own")


def missing_counters(seen: DataFrame, floors: DataFrame | None = None) -> DataFrame:
    """Counters between a device's floor (at least 1) and its highest that never arrived.

    Only the holes are listed, each from its two neighbours.
    """
    have = seen.where("counter > 0").select("device_id", "counter").distinct()
    linked = neighbour(have, ["device_id"], ["counter"], "counter", SLICE_ROWS, ["counter"], "before")
    start = F.coalesce(F.col("before.counter") + 1, F.lit(1))
    if floors is not None:
        linked = linked.join(floors.select("device_id", "floor"), "device_id", "left")
        start = F.greatest(start, F.coalesce("floor", F.lit(1)))
    holes = linked.select("device_id", start.alias("a"), (F.col("counter") - 1).alias("b")).where("a <= b")
    # In two steps, so a hole of a billion never stands as one array in a row.
    parts = holes.select("device_id", "b", F.explode(F.sequence("a", "b", F.lit(SLICE_ROWS).cast("long"))).alias("a"))
    return parts.select("device_id", F.explode(F.sequence("a", F.least("b", F.col("a") + (SLICE_ROWS - 1)))).alias("counter"))


def assignment_verdicts(offers: DataFrame, assignments: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Why a bundle's assignment is refused, or ``ok``: unknown, mismatch, archived, superseded, in that order.

    ``assignments``: assignment_id, device_id, vehicle_id, seq, is_open, first_counter.
    A later assignment of the device supersedes a closed one from its first counter on. Ids are taken in lower case.
    """
    ids = ("assignment_id", "device_id", "vehicle_id")
    offers, assignments, vehicles = (folded(rows, *ids) for rows in (offers, assignments, vehicles))
    later = Window.partitionBy("device_id").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.min(F.when(F.col("first_counter") != 0, F.col("first_counter"))).over(later)
    claims = assignments.select(
        "assignment_id",
        F.col("device_id").alias("_device"),
        F.col("vehicle_id").alias("_vehicle"),
        "is_open",
        taken.alias("_taken_from"),
    )
    retired = vehicles.where("archived").select(F.col("vehicle_id").alias("_vehicle"), F.lit(True).alias("_archived"))
    rows = offers.join(claims.join(retired, "_vehicle", "left"), "assignment_id", "left")
    verdict = (
        F.when(F.col("_device").isNull(), "unknown")
        .when((F.col("_device") != F.col("device_id")) | (F.col("_vehicle") != F.col("vehicle_id")), "mismatch")
        .when(F.col("_archived"), "archived")
        .when(~F.col("is_open") & (F.col("counter") > F.col("_taken_from")), "superseded")
        .otherwise("ok")
    )
    return rows.withColumn("verdict", verdict).select(*offers.columns, "verdict")


def assignment_ranges(accepted: DataFrame) -> DataFrame:
    """Lowest and highest counter accepted under each assignment."""
    return accepted.groupBy("assignment_id").agg(
        F.min(F.when(F.col("counter") != 0, F.col("counter"))).alias("first_counter"), F.max("counter").alias("last_counter")
    )
