"""State kept per key between the batches of a stream, and ordered walks that carry it.

``foreachBatch`` functions set a batch against the state of its keys. A walk reads the rows of a key in order as a stream: its state
row comes first, one row is in memory at a time, and after its last row the new state is handed on. So a key may have any
number of rows in a batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from odolake.session import settle
from odolake.sources.tables import path_exists

BUCKETS = 32
#: After so many batches the newest rows of all keys are written together, so that a batch reads no more than that many.
TOGETHER = 16

Batch = Callable[[DataFrame, int], None]


class KeyedStore:
    """Rows of which the newest of a key counts. Each batch has its own folder, so a batch that is run again writes the same."""

    def __init__(self, path: str, key: Sequence[str], schema: str):
        self.path, self.key, self.schema = path, list(key), schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(BUCKETS)).cast("int").alias("bucket")

    def _rows(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Everything that earlier batches left, from the last time it was written together on."""
        wholes = [n for n in range(batch_id // TOGETHER * TOGETHER, 0, -TOGETHER) if path_exists(spark, f"{self.path}/whole/batch={n}/_SUCCESS")][:1]
        start = wholes[0] if wholes else 0
        parts = [n for n in range(start, batch_id) if path_exists(spark, f"{self.path}/part/batch={n}")]
        rows = spark.createDataFrame([], f"{self.schema}, batch int, bucket int")
        for kind, found in (("whole", wholes), ("part", parts)):
            if found:
                base = f"{self.path}/{kind}"
                reader = spark.read.schema(f"{self.schema}, batch int, bucket int").option("basePath", base)
                # What was written together comes before the batches since.
                order = F.col("batch") - (1 if kind == "whole" else 0)
                rows = rows.unionByName(reader.parquet(*[f"{base}/batch={n}" for n in found]).withColumn("batch", order))
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        others = [f.name for f in rows.schema if f.name not in (*self.key, "bucket", "batch")]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*others), "batch").alias("_x")).select(*self.key, "_x.*")

    def read(self, keys: DataFrame, batch_id: int) -> DataFrame:
        """The rows of the given keys as the batches before this one left them; only the keys' buckets are read. Keys aren't NULL."""
        buckets = [r.bucket for r in keys.select(self._bucket()).distinct().collect()]
        rows = self._rows(keys.sparkSession, batch_id).where(F.col("bucket").isin(buckets))
        return self._newest(rows.join(keys.select(*self.key).distinct(), self.key, "left_semi"))

    def write(self, rows: DataFrame, batch_id: int) -> None:
        self._put(rows, f"{self.path}/part/batch={batch_id}")
        if (batch_id + 1) % TOGETHER == 0:
            self._put(self._newest(self._rows(rows.sparkSession, batch_id + 1)), f"{self.path}/whole/batch={batch_id + 1}")

    def _put(self, rows: DataFrame, folder: str) -> None:
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)


class Walk(Protocol):
    """The state of one key; made new for each key from what was stored (None at first)."""

    def __init__(self, stored: dict | None): ...

    def take(self, row: dict) -> Iterator[tuple]:
        """The results of a row, as they become known."""

    def state(self) -> dict | None:
        """What to keep, as JSON can say it; None keeps nothing."""


def walked(root: str, key: Sequence[str], order: Sequence[str], walk: type[Walk], results: str) -> Batch:
    """Walk every key's rows of a batch in order, go on from where the last batch left off, and add to ``root``/out.

    Rows without a key are left out. ``results`` is the schema of what ``walk`` gives.
    """
    key = list(key)

    def step(batch: DataFrame, batch_id: int) -> None:
        types = {f.name: f.dataType.simpleString() for f in batch.schema}
        store = KeyedStore(f"{root}/state", key, ", ".join(f"`{k}` {types[k]}" for k in key) + ", state string")
        rows = batch.dropna(subset=key)
        states = store.read(rows.select(*key), batch_id)
        both = rows.withColumn("_turn", F.lit(1)).unionByName(states.withColumnRenamed("state", "_state").withColumn("_turn", F.lit(0)), allowMissingColumns=True)
        ordered = both.repartition(*key).sortWithinPartitions(*key, "_turn", *order)
        empty = batch.sparkSession.createDataFrame([], results)
        keys = ", ".join(f"_k{i} {types[k]}" for i, k in enumerate(key))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema) + f", {keys}, _state string"
        out = settle(ordered.mapInArrow(_stream(key, walk, empty.columns, ordered.sparkSession.createDataFrame([], schema).schema), schema))
        out.where("_state IS NULL").select(*empty.columns).write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")
        kept = out.where("_state IS NOT NULL").select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(key)], F.col("_state").alias("state"))
        store.write(kept, batch_id)

    return step


def _stream(key: list[str], walk: type[Walk], names: list[str], schema):
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, held = None, None, []

        def done() -> None:
            kept = current.state()
            held.append((*(None,) * len(names), *at, json.dumps(kept)))

        def handed_on() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [()] * len(arrow)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        blank = (None,) * (len(key) + 1)
        for batch in batches:
            for row in batch.to_pylist():
                here = tuple(row[k] for k in key)
                if here != at:
                    if current is not None:
                        done()
                    at = here
                    stored = row["_state"] if row["_turn"] == 0 else None
                    current = walk(None if stored is None else json.loads(stored))
                if row["_turn"] == 0:
                    continue
                held += [(*found, *blank) for found in current.take(row)]
            yield handed_on()
        if current is not None:
            done()
            yield handed_on()

    return run


def results(spark: SparkSession, root: str) -> DataFrame:
    """What the walk gave in all batches so far."""
    return spark.read.parquet(f"{root}/out")
