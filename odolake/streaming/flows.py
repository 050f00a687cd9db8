"""Streaming forms of the batch views: intake, sessions, event alerts, and the trip feed.

Cars upload days late, so nothing here rests on a watermark: every batch is set against what is stored, in ``foreachBatch``
functions. What they store is a log with a folder for each batch, so a batch that is run again after a failure writes
the same folders again. Inside it, folders for hash buckets, and for sessions of blocks of days, keep a batch from reading more than it
touches. A batch that touches many days lists them in wider blocks, so its folders don't grow in number with the days.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odolake.functions.timecols import from_millis, millis
from odolake.operators.slices import SLICE, number_sessions, slice_of
from odolake.plans.bundle import sample_events
from odolake.plans.synclog import change_feed
from odolake.session import settle
from odolake.sources.tables import Tables, path_exists

OUTING_BREAK_MS = 3_600_000
LEG_BREAK_MS = 60_000
SLICE_MS = 60_000
DAY_MS = 86_400_000
BUCKETS = 64
#: Folders a batch lists its sessions in; two for each bucket it touches if these are more.
FOLDERS = 64
SESSION = "vehicle_id string, lo long, hi long, n long"

Batch = Callable[[DataFrame, int], None]


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _log(df: DataFrame, path: str, batch_id: int, key: str) -> None:
    """Write a batch's rows to its own folder, one folder for each bucket of the key."""
    rows = df.withColumn("bucket", _bucket(key))
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")


def _logged(spark: SparkSession, path: str, schema: str, batch_id: int, keys: DataFrame, key: str) -> DataFrame:
    """Rows of earlier batches with one of the given keys; only their buckets' folders are read."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], f"{schema}, batch int")
    buckets = [r.bucket for r in keys.select(_bucket(key).alias("bucket")).distinct().collect()]
    rows = spark.read.schema(f"{schema}, batch int, bucket int").option("basePath", path).parquet(path)
    rows = rows.where((F.col("batch") < batch_id) & F.col("bucket").isin(buckets)).drop("bucket")
    return rows.join(keys, key, "left_semi")


def intake(root: str) -> Batch:
    """Each content_root once, however often and however late it is delivered: the first row of ``root``/accepted counts.

    Other columns of a delivery (content_root, ...) are not kept. A null content_root is no bundle and is left out.
    """

    def accept(batch: DataFrame, batch_id: int) -> None:
        seen = settle(batch.where("content_root IS NOT NULL").select("content_root").distinct())
        path = f"{root}/accepted"
        stored = _logged(batch.sparkSession, path, "content_root string", batch_id, seen, "content_root")
        _log(seen.join(stored, "content_root", "left_anti"), path, batch_id, "content_root")

    return accept


def _blocks(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """(width, number) of the blocks of days that sessions are listed in; widths are powers of two, so blocks nest."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/days/width=*/block=*")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern) or ()
    paths = [(f.getPath().getParent().getName(), f.getPath().getName()) for f in found]
    return [(int(w.removeprefix("width=")), int(n.removeprefix("block="))) for w, n in paths]


def _touched(blocks: list[tuple[int, int]], days: list[int]) -> list[tuple[int, int]]:
    wanted = {w: {d // w for d in days} for w in {w for w, _ in blocks}}
    return [(w, n) for w, n in blocks if n in wanted[w]]


def _session_rows(spark: SparkSession, root: str, days: list[int] | None = None) -> DataFrame | None:
    """Versions of sessions listed under the given days (all if None): vehicle_id, lo, hi, n, day, bucket, batch.

    The blocks of these days may hold others too.
    """
    base = f"{root}/days"
    blocks = _blocks(spark, root)
    if days is not None:
        blocks = _touched(blocks, days)
    if not blocks:
        return None
    reader = spark.read.schema(f"{SESSION}, day int, width int, block int, bucket int, batch int").option("basePath", base)
    return reader.parquet(*([base] if days is None else [f"{base}/width={w}/block={n}" for w, n in blocks])).drop("width", "block")


def _newest(rows: DataFrame) -> DataFrame:
    last = rows.groupBy("vehicle_id", "lo").agg(F.max_by(F.struct("hi", "n"), "batch").alias("x"))
    return last.where("x.n > 0").select("vehicle_id", "lo", "x.hi", "x.n")


def neighbours(spark: SparkSession, root: str, batch_id: int, spans: DataFrame, break_ms: int) -> DataFrame:
    """Stored sessions (vehicle_id, lo, hi, n) that spans (vehicle_id, lo, hi) may touch, as earlier batches left them.

    A session is listed under every day it lasts, so only the blocks with the days of the spans and of the break around them are
    read; other sessions of these days and vehicles may be among them.
    """
    near = F.sequence(_day(F.col("lo") - break_ms), _day(F.col("hi") + break_ms))
    reach = settle(spans.select("vehicle_id", F.explode(near).alias("day")).distinct())
    days = [r.day for r in reach.select("day").distinct().collect()]
    rows = _session_rows(spark, root, days)
    if rows is None:
        return spark.createDataFrame([], SESSION)
    buckets = [r.bucket for r in reach.select(_bucket("vehicle_id").alias("bucket")).distinct().collect()]
    rows = rows.where((F.col("batch") < batch_id) & F.col("bucket").isin(buckets))
    return _newest(rows.join(reach, ["vehicle_id", "day"], "left_semi"))


def sessions(root: str, break_ms: int) -> Batch:
    """Sessions of the samples (vehicle_id, observed_at) a stream delivers, in any order and however late.

    Stored sessions are more than the break apart, so what a batch leaves alone stays as it is: its minutes are merged
    with the sessions near them, whose samples add up. What changed goes to ``root``/changes, with the version before, and
    is listed under ``root``/days by every day of the session: one that got other times or samples is written again under
    its start, one whose start moved or that was joined to another is withdrawn with samples 0. ``present`` reads the outcome,
    ``compact`` drops what was replaced. Rows without vehicle or time belong to no session.
    """
    if break_ms < SLICE_MS:
        raise ValueError("a session must outlast a slice")

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        timed = batch.select("vehicle_id", millis("observed_at").alias("at")).dropna()
        minutes = timed.groupBy("vehicle_id", slice_of("at", SLICE_MS).alias(SLICE)).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
        spans = number_sessions(minutes, ["vehicle_id"], "lo", "hi", break_ms, "session").groupBy("vehicle_id", "session")
        added = settle(spans.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("session"))
        before = settle(neighbours(spark, root, batch_id, added, break_ms))
        # Old and new sessions of a vehicle may overlap, so the latest end so far decides.
        along = Window.partitionBy("vehicle_id").orderBy("lo", "hi")
        latest = F.max("hi").over(along.rowsBetween(Window.unboundedPreceding, -1))
        marked = before.unionByName(added).withColumn("_opens", F.when(F.col("lo") - latest > break_ms, 1).otherwise(0))
        numbered = marked.withColumn("_session", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        after = numbered.groupBy("vehicle_id", "_session").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).drop("_session")
        both = after.join(before.toDF("vehicle_id", "lo", "old_hi", "old_n"), ["vehicle_id", "lo"], "full")
        changed = settle(both.where("NOT (hi <=> old_hi AND n <=> old_n)"))
        changed.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")
        version = changed.select("vehicle_id", "lo", F.coalesce("hi", "old_hi").alias("hi"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        listed = version.withColumns({"day": F.explode(F.sequence(_day("lo"), _day("hi"))), "bucket": _bucket("vehicle_id"), "batch": F.lit(batch_id)})
        _put(listed, f"{root}/days")

    return step


def _day(at: Column | str) -> Column:
    return slice_of(at, DAY_MS).cast("int")


def _put(listed: DataFrame, path: str) -> None:
    """Write the folders of a batch, replacing those of the same block, bucket and batch only.

    A block is as many days wide as it takes for a batch to have no more than about ``FOLDERS`` folders, however many days it touches.
    """
    # As many numbers as there are days and buckets.
    days = [r.day for r in listed.select("day").distinct().collect()]
    buckets = listed.select("bucket").distinct().count()
    width = 1
    while (blocks := len({d // width for d in days})) > 2 and blocks * buckets > FOLDERS:
        width *= 2
    rows = listed.withColumns({"width": F.lit(width), "block": F.floor(F.col("day") / width).cast("int")}).repartition("block", "bucket")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("width", "block", "bucket", "batch").parquet(path)


def present(spark: SparkSession, root: str, vehicles: DataFrame | None = None) -> DataFrame:
    """vehicle_id, started_at, ended_at, samples of the sessions as the last batch left them, of the given vehicles or of all."""
    rows = _session_rows(spark, root)
    rows = spark.createDataFrame([], f"{SESSION}, day int, bucket int, batch int") if rows is None else rows
    if vehicles is not None:
        buckets = [r.bucket for r in vehicles.select(_bucket("vehicle_id").alias("bucket")).distinct().collect()]
        rows = rows.where(F.col("bucket").isin(buckets)).join(vehicles.select("vehicle_id").distinct(), "vehicle_id", "left_semi")
    # The day a session starts on has all of its versions.
    found = _newest(rows.where(F.col("day") == _day("lo")))
    return found.select("vehicle_id", from_millis("lo").alias("started_at"), from_millis("hi").alias("ended_at"), F.col("n").alias("samples"))


def compact(spark: SparkSession, root: str, upto: int, days: list[int] | None = None) -> None:
    """Keep only the newest version up to a batch, which must be done, of the sessions of the given days and of those
    that share a block with them (all if None).

    The newest versions, withdrawals among them, are written under that batch first, so a reader finds the same before
    and after, and a run that breaks off may be repeated; then the folders of earlier batches go.
    """
    blocks = _blocks(spark, root)
    if days is not None:
        # What shares a folder with these days goes along: blocks nest, so the widest that hold them decide.
        for _ in range(len({w for w, _ in blocks})):
            held = _touched(blocks, days)
            days = sorted({*days, *(d for w, n in held for d in range(w * n, w * n + w))})
        blocks = held if blocks else []
    rows = _session_rows(spark, root, days)
    if rows is None:
        return
    newest = rows.where(F.col("batch") <= upto).groupBy("vehicle_id", "lo", "day", "bucket").agg(F.max_by(F.struct("hi", "n"), "batch").alias("x"))
    _put(settle(newest.select("vehicle_id", "lo", "x.hi", "x.n", "day", "bucket", F.lit(upto).alias("batch"))), f"{root}/days")
    wanted = {(f"width={w}", f"block={n}") for w, n in blocks}
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/days/width=*/block=*/bucket=*/batch=*")
    system = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for found in system.globStatus(pattern) or ():
        folder = found.getPath()
        block = folder.getParent().getParent()
        if int(folder.getName().removeprefix("batch=")) < upto and (block.getParent().getName(), block.getName()) in wanted:
            system.delete(folder, True)


def outings(root: str) -> Batch:
    """Outings of position, engine and motion samples (vehicle_id, observed_at)."""
    return sessions(root, OUTING_BREAK_MS)


def present_outings(spark: SparkSession, root: str) -> DataFrame:
    return present(spark, root).withColumn("trip_id", F.concat_ws(":", "vehicle_id", millis("started_at").cast("string")))


def legs(root: str) -> Batch:
    """Legs of samples of movement (vehicle_id, observed_at)."""
    return sessions(root, LEG_BREAK_MS)


def alerts(t: Tables) -> DataFrame:
    """Events that one row decides, from streams of imu, status and gap rows. No state is kept."""
    return sample_events(t)


def trip_feed(root: str, sessions_root: str, describe: Callable[[DataFrame], DataFrame]) -> Batch:
    """A ``foreachBatch`` function, called after the one of ``sessions``, that publishes what a batch changed about its sessions.

    ``describe`` turns sessions (vehicle_id, lo, hi, n) into entity state (see ``entity_state``). A session that late data
    re-keys appears as a tombstone of the old id and a new row. Both sides come from the batch's own changes, so
    nothing that was published before is read again; the feed under ``root``/feed has a folder for each batch.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        schema = f"{SESSION}, old_hi long, old_n long"
        changes = batch.sparkSession.read.schema(schema).parquet(f"{sessions_root}/changes/batch={batch_id}")
        before = describe(changes.where("old_n IS NOT NULL").selectExpr("vehicle_id", "lo", "old_hi AS hi", "old_n AS n"))
        now = describe(changes.where("n IS NOT NULL").select("vehicle_id", "lo", "hi", "n"))
        last = before.select("entity_type", "entity_id", "vehicle_id", "digest")
        change_feed(last, now).write.mode("overwrite").parquet(f"{root}/feed/batch={batch_id}")

    return publish
