"""Ways to store tables: ordered, by month, replaced per bundle, exported as a snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.session import settle
from odolake.sources.tables import Tables, path_exists

SNAPSHOT_TABLES = ("bundles", "position", "imu", "obd", "boost", "status", "transition", "gap")
ORDER = ("vehicle_id", "boot_id", "mono_ms", "seq")
#: The month of rows without a time.
UNDATED = "undated"


def write_ordered(df: DataFrame, path: str, partitions: int | None = None, order: tuple[str, ...] = ORDER) -> None:
    """Rows in key and clock order, so that row-group statistics skip what a time filter leaves out.

    The ranges include the clock: a boot with very many rows spans several files.
    """
    cols = [c for c in order if c in df.columns]
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *cols)
    ranged.sortWithinPartitions(*cols).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_store(tables: Tables, root: str, partitions: int | None = None) -> None:
    """All tables of a store, each in order under its own folder."""
    for name in tables:
        write_ordered(tables[name], f"{root.rstrip('/')}/{name}", partitions)


def with_month(df: DataFrame, time_column: str) -> DataFrame:
    return df.withColumn("month", F.coalesce(F.date_format(time_column, "yyyy-MM"), F.lit(UNDATED)))


def _whereabouts(path: str) -> str:
    """Where a store by month keeps which months its bundles have rows in."""
    return f"{path.rstrip('/')}.whereabouts"


def _note(rows: DataFrame, path: str, mode: str) -> None:
    """Add (content_root, month) pairs; one too many only costs a look into that month."""
    if "content_root" in rows.columns:
        rows.select("content_root", "month").distinct().write.mode(mode).parquet(_whereabouts(path))


def write_months(df: DataFrame, path: str, time_column: str, mode: str = "append") -> None:
    """One folder per month of the row's time; a month spreads over several files by boot and clock."""
    rows = with_month(df, time_column)
    _note(rows, path, mode)
    cols = ["month", *[c for c in ORDER if c in df.columns]]
    rows = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    rows.write.mode(mode).partitionBy("month").option("compression", "zstd").parquet(path)


def stored_months(spark: SparkSession, path: str, months: list[str]) -> DataFrame:
    """The rows of some months; only their folders are read."""
    return spark.read.parquet(path).withColumn("month", F.col("month").cast("string")).where(F.col("month").isin(months))


def replace_bundles(spark: SparkSession, path: str, new: DataFrame, time_column: str) -> None:
    """Replace the rows of the bundles in ``new``; running it again changes nothing.

    Only months that hold such rows, before or after, are read and rewritten. Rows without a time have a month of
    their own. Rows without a content_root belong to no bundle and are not replaced.
    """
    fresh = settle(with_month(new, time_column))
    if not path_exists(spark, path):
        write_months(fresh.drop("month"), path, time_column, "overwrite")
        return
    roots = fresh.select("content_root").distinct()
    known = spark.read.parquet(_whereabouts(path)).join(roots, "content_root", "left_semi").select("month")
    # One value for each month there is; the list prunes the scan.
    touched = [r.month for r in known.union(fresh.select("month")).distinct().collect()]
    _note(fresh, path, "append")
    kept = stored_months(spark, path, touched).join(roots, "content_root", "left_anti")
    merged = settle(kept.select(*fresh.columns).unionByName(fresh))
    # A month whose last rows moved away keeps its folder unless it is written empty.
    left = {r.month for r in merged.select("month").distinct().collect()}
    (
        merged.repartitionByRange("month", *[c for c in ORDER if c in merged.columns])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("month")
        .parquet(path)
    )
    for month in set(touched) - left:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/month={month}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def export_snapshot(frames: Tables, root: str) -> DataFrame:
    """Sample tables and the two summaries, each in the order of vehicle and clock; returns the row count of every vehicle and table.

    ``frames`` holds the tables plus ``v_drive_summary`` and ``v_trip_summary``. A table's files are ranges of that order, so
    their number follows the bytes and not the vehicles, and a vehicle with very many rows spans several of them. The folder
    ``manifest`` says how many rows of which vehicle a file holds (table, vehicle_id, file, rows), itself in order of vehicle;
    ``snapshot_slice`` finds a vehicle's files by it. It is taken from what was stored, by reading back one sorted column.
    """
    named = {n: frames[n] for n in SNAPSHOT_TABLES}
    named["drive_summary"] = frames["v_drive_summary"]
    named["trip_summary"] = frames["v_trip_summary"]
    base = root.rstrip("/")
    held = []
    for name, df in named.items():
        write_ordered(df, f"{base}/{name}", order=("vehicle_id", "boot_id", "mono_ms", "seq", "started_at"))
        stored = df.sparkSession.read.parquet(f"{base}/{name}")
        file = F.col("_metadata.file_name").alias("file")
        held.append(stored.groupBy(F.lit(name).alias("table"), "vehicle_id", file).agg(F.count(F.lit(1)).alias("rows")))
    write_ordered(reduce(DataFrame.unionByName, held), f"{base}/manifest", order=("vehicle_id", "table", "file"))
    manifest = named["bundles"].sparkSession.read.parquet(f"{base}/manifest")
    return manifest.groupBy("table", "vehicle_id").agg(F.sum("rows").alias("rows"))


def snapshot_slice(spark: SparkSession, root: str, table: str, vehicles: Sequence[str | None]) -> DataFrame:
    """Some vehicles' rows of a snapshot's table; only files that the manifest names for them are opened.

    None stands for the rows without a vehicle. Of an unknown vehicle there are no rows.
    """
    base = root.rstrip("/")
    named = [v for v in vehicles if v is not None]
    mine = F.col("vehicle_id").isin(named)
    if len(named) < len(vehicles):
        mine = mine | F.col("vehicle_id").isNull()
    manifest = spark.read.parquet(f"{base}/manifest")
    # As many names as these vehicles have files.
    files = [r.file for r in manifest.where((F.col("table") == table) & mine).select("file").distinct().collect()]
    if not files:
        return spark.read.parquet(f"{base}/{table}").where(F.lit(False))
    return spark.read.parquet(*[f"{base}/{table}/{f}" for f in sorted(files)]).where(mine)
