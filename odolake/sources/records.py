"""JSON-lines records: the lifecycle ledger and the audit trail, one file per day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odolake.schemas import AUDIT, LEDGER
from odolake.sources.tables import path_exists

BAD_LINE = "_bad_line"


def _with_bad_line(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(BAD_LINE, T.StringType())])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger entries with their place (``seq``); a line that is not an entry keeps its text in ``_bad_line``."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_LINE}
    parsed = F.from_json("value", _with_bad_line(LEDGER), options).alias("e")
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = spark.read.text(path).select(parsed, place.alias("place"))
    return rows.select(
        "e.*", F.struct("e.utc_ms", "place.file_path", "place.file_block_start", "place.n").alias("seq")
    )


def entries(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(BAD_LINE).isNull() & F.col("event").isNotNull()).drop(BAD_LINE)


def bad_lines(rows: DataFrame) -> DataFrame:
    """Every malformed line with its file, not only the first."""
    return rows.where(F.col(BAD_LINE).isNotNull()).select(F.col("seq.file_path").alias("file"), F.col(BAD_LINE).alias("line"))


def read_audit(spark: SparkSession, root: str, days: int, today: dt.date, suffix: str = ".jsonl") -> DataFrame:
    """Audit entries of the last ``days`` day files up to ``today``; only those files are opened."""
    names = [f"{root.rstrip('/')}/{today - dt.timedelta(days=n)}{suffix}" for n in range(days)]
    found = [p for p in names if path_exists(spark, p)]
    if not found:
        return spark.createDataFrame([], AUDIT)
    return spark.read.schema(AUDIT).json(found)
