"""The batch load: from the rows of new bundles to samples, trips, segments, events, gaps, runs and daily rollups, all or nothing.

Every output of a batch is written to a folder of its own, and last of all a commit that lists the batch's bundles. Readers take
a bundle's rows from the newest committed batch that has it. So a bundle that is delivered again replaces its rows without
anything being deleted, a batch that breaks off between two outputs leaves nothing to be seen, and running it again,
before or after the commit, writes the same folders. Nothing but the changed bundles' own earlier rows is read.

Rollups go on from their last version by the difference that the batch's bundles make to their days. Sums and counts are added
and taken away; only where the bundle that held a day's top speed lost it, that day's tops are looked up again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.functions.rawrows import typed_tables
from odolake.plans import bundle, repair
from odolake.schemas import COUNTED_TABLES, TIME_COLUMN
from odolake.session import settle
from odolake.sources.tables import Tables, path_exists

ROOT = ["content_root"]
DAY = ["vehicle_id", "device_id", "day"]
ADDED = ("trip_count", "distance_m", "duration_s", "gap_duration_s", "event_count")
DERIVED = ("trips", "segments", "events", "gaps", "runs", "shares")


def derive(t: Tables, decoder_version: int) -> dict[str, DataFrame]:
    """All outputs of some bundles: the repaired samples and what follows from them."""
    t = t.replace(position=settle(repair.jump_gate(t.position, t.gap)), obd=repair.clear_unavailable_speed(t.obd))
    trips = settle(bundle.bundle_trips(t))
    devices = t.bundles.select("content_root", "device_id")
    events = settle(bundle.bundle_events(t, trips).join(devices, ROOT, "left"))
    counts = reduce(DataFrame.unionByName, [t[n].groupBy(*ROOT).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(n)) for n in COUNTED_TABLES])
    counted = counts.groupBy(*ROOT).agg(*[F.coalesce(F.sum(F.when(F.col("kind") == n, F.col("n"))), F.lit(0)).alias(f"n_{n}") for n in COUNTED_TABLES])
    digests = repair.bundle_digests(t, {n: [c for c in t[n].columns if c != "content_root"] for n in COUNTED_TABLES})
    runs = t.bundles.select("content_root").distinct().join(counted, ROOT, "left").join(digests.drop("rows"), ROOT, "left")
    return {
        **{n: t[n] for n in COUNTED_TABLES},
        "trips": trips, "segments": bundle.trip_segments(t), "events": events, "gaps": bundle.gap_rows(t, trips),
        "runs": runs.withColumn("decoder_version", F.lit(decoder_version)), "shares": day_shares(trips, events),
    }


def day_shares(trips: DataFrame, events: DataFrame) -> DataFrame:
    """What each bundle adds to each day of its vehicle and device."""
    zero = F.lit(0).cast("long")
    driven = trips.select(
        *ROOT, "vehicle_id", "device_id", F.col("started_at").cast("date").alias("day"), F.lit(1).cast("long").alias("trip_count"), "distance_m", "duration_s",
        "gap_duration_s", zero.alias("event_count"), "max_speed_mps",
    )
    happened = events.select(
        *ROOT, "vehicle_id", "device_id", F.col("occurred_at").cast("date").alias("day"), zero.alias("trip_count"), F.lit(0.0).alias("distance_m"), zero.alias("duration_s"),
        zero.alias("gap_duration_s"), F.lit(1).cast("long").alias("event_count"), F.lit(None).cast("double").alias("max_speed_mps"),
    )
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ADDED]
    return driven.unionByName(happened).groupBy(*ROOT, *DAY).agg(*sums, F.max("max_speed_mps").alias("max_speed_mps"))


def load_records(raw: Mapping[str, DataFrame], root: str, batch: int, decoder_version: int = 1) -> None:
    """``load_bundles`` from raw record fields; what the records state that the format does not define is output ``warnings``.

    ``raw`` holds the raw tables and ``bundles`` with the clock basis (utc_basis_ms) of each.
    """
    t, flawed = typed_tables(raw, raw["bundles"])
    load_bundles(t, root, batch, decoder_version, {"warnings": flawed})


def load_bundles(t: Tables, root: str, batch: int, decoder_version: int = 1, more: Mapping[str, DataFrame] | None = None) -> None:
    """Load the bundles of ``t`` (``t.bundles`` lists them) under ``root`` as one batch; later batches have higher numbers.

    ``more`` are outputs of the caller's, by name, which the same commit makes visible; they have a content_root.
    """
    outputs = {**derive(t, decoder_version), **(more or {})}
    outputs["shares"] = settle(outputs["shares"])
    roots = settle(t.bundles.select("content_root").dropna().distinct())
    outputs["rollups"] = _rolled_up(root, batch, outputs["shares"], roots)
    for name, rows in outputs.items():
        _write(rows, root, name, batch)
    _write(roots, root, "commits", batch)


def _write(rows: DataFrame, root: str, name: str, batch: int) -> None:
    if name in COUNTED_TABLES:
        # In order of bundle and time, so that a reader of some bundles skips the rest by the files' statistics.
        rows = rows.repartitionByRange(*ROOT, TIME_COLUMN[name]).sortWithinPartitions(*ROOT, TIME_COLUMN[name])
    rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")


def _committed(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """content_root and batch of everything that was committed."""
    if not path_exists(spark, f"{root}/commits"):
        return None
    rows = spark.read.parquet(f"{root}/commits")
    return rows if before is None else rows.where(F.col("batch") < before)


def _stored(spark: SparkSession, root: str, name: str, batches: Sequence[int]) -> DataFrame | None:
    """The folders of some batches; others aren't opened."""
    paths = [f"{root}/{name}/batch={b}" for b in batches]
    return spark.read.option("basePath", f"{root}/{name}").parquet(*paths) if paths else None


def loaded(spark: SparkSession, root: str, name: str, before: int | None = None, roots: DataFrame | None = None) -> DataFrame | None:
    """The present rows of an output, of all bundles or of those in ``roots``; None if nothing was committed."""
    commits = _committed(spark, root, before)
    if commits is None:
        return None
    if roots is not None:
        commits = commits.join(roots, ROOT, "left_semi")
    newest = commits.groupBy(*ROOT).agg(F.max("batch").alias("batch"))
    rows = _stored(spark, root, name, sorted(r.batch for r in newest.select("batch").distinct().collect()))
    return None if rows is None else rows.join(newest, [*ROOT, "batch"], "left_semi").drop("batch")


def _versions(spark: SparkSession, root: str, before: int | None) -> DataFrame | None:
    """The newest committed version of every day's totals."""
    commits = _committed(spark, root, before)
    batches = [] if commits is None else sorted(r.batch for r in commits.select("batch").distinct().collect())
    rows = _stored(spark, root, "rollups", batches)
    if rows is None:
        return None
    totals = F.struct(*ADDED, "max_speed_mps")
    return rows.groupBy(*DAY).agg(F.max_by(totals, "batch").alias("x")).select(*DAY, "x.*")


def _rolled_up(root: str, batch: int, shares: DataFrame, roots: DataFrame) -> DataFrame:
    """New versions of the days the batch's bundles have or had a share in."""
    spark = shares.sparkSession
    gone = loaded(spark, root, "shares", batch, roots)
    gone = spark.createDataFrame([], shares.schema) if gone is None else gone.select(*shares.columns)
    signed = shares.withColumn("_sign", F.lit(1)).unionByName(gone.withColumn("_sign", F.lit(-1)))
    top = F.col("max_speed_mps")
    delta = settle(
        signed.groupBy(*DAY).agg(
            *[F.sum(F.col(c) * F.col("_sign")).alias(f"_{c}") for c in ADDED],
            F.max(F.when(F.col("_sign") > 0, top)).alias("_new_top"), F.max(F.when(F.col("_sign") < 0, top)).alias("_old_top"),
        )
    )
    last = _versions(spark, root, batch)
    if last is None:
        return delta.select(*DAY, *[F.col(f"_{c}").alias(c) for c in ADDED], F.col("_new_top").alias("max_speed_mps"))
    same = reduce(lambda a, b: a & b, [F.col(f"d.{c}").eqNullSafe(F.col(f"l.{c}")) for c in DAY])
    both = settle(delta.alias("d").join(last.alias("l"), same, "left").select("d.*", *[F.col(f"l.{c}") for c in (*ADDED, "max_speed_mps")]))
    lost = (F.col("_old_top") >= top) & (F.coalesce("_new_top", F.lit(-1.0)) < F.col("_old_top"))
    again = settle(both.where(lost).select(*DAY))
    kept = loaded(spark, root, "shares", batch)
    others = kept.join(roots, ROOT, "left_anti").join(again, DAY, "left_semi").groupBy(*DAY).agg(F.max("max_speed_mps").alias("_others"))
    placed = both.join(others, DAY, "left")
    now = F.when(lost, F.greatest("_others", "_new_top")).otherwise(F.greatest(top, F.col("_new_top")))
    return placed.select(*DAY, *[(F.coalesce(c, F.lit(0)) + F.col(f"_{c}")).alias(c) for c in ADDED], now.alias("max_speed_mps"))


def rollups(spark: SparkSession, root: str) -> DataFrame | None:
    """Totals per vehicle, device and day that has a trip, as the last committed batch left them."""
    rows = _versions(spark, root, None)
    return None if rows is None else rows.where("trip_count > 0")
