"""What the operators share: tables, row hygiene, kept intermediate results."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.session import checkpoint_dir

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame) -> DataFrame:
    """Write a result that is read several times to the shared folder of spark.checkpoint.dir.

    The copy survives the loss of any executor and cuts the lineage; it is compressed and
    columnar, so readers take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def short_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python tasks get texts in batches of so many rows at most: a batch is held in memory on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def holds_out(column: str, modulus: int, remainder: int) -> Column:
    """crc32 of a column as text, modulo a number; False where the column is null."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus == remainder, F.lit(False))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice have about so many bytes; one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    yield batch.slice(start)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
