"""The set of sample tables a computation reads."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

from odolake.schemas import SAMPLE_TABLES


class Tables(Mapping[str, DataFrame]):
    """Named DataFrames with attribute access; ``replace`` gives a changed copy.

    A frame may be given as a function without arguments, which is called on first use.
    """

    def __init__(self, frames: Mapping[str, DataFrame | Callable[[], DataFrame]]):
        self._frames = dict(frames)

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._frames:
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def replace(self, **frames: DataFrame) -> Tables:
        return Tables({**self._frames, **frames})


def scan(spark: SparkSession, root: str, optional: Collection[str] = ()) -> Tables:
    """Typed scan of every sample table under ``root``, one folder per table.

    A missing folder is an error, unless the table is named in ``optional``: then it is empty.
    """
    frames = {}
    for name, schema in SAMPLE_TABLES.items():
        path = f"{root.rstrip('/')}/{name}"
        if path_exists(spark, path):
            frames[name] = spark.read.schema(schema).parquet(path)
        elif name in optional:
            frames[name] = spark.createDataFrame([], schema)
        else:
            raise FileNotFoundError(f"no folder for table {name} under {root}")
    return Tables(frames)


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def complete(tables: Mapping[str, DataFrame], spark: SparkSession) -> Tables:
    """Give every table all of its columns, NULL where the input has none, and empty tables where absent."""
    frames = {}
    for name, schema in SAMPLE_TABLES.items():
        empty = spark.createDataFrame([], schema)
        frame = tables.get(name)
        if frame is None:
            frames[name] = empty
            continue
        extra = [c for c in frame.columns if c not in schema.fieldNames()]
        frames[name] = frame.selectExpr(
            *[
                f"cast(`{f.name}` AS {f.dataType.simpleString()}) AS `{f.name}`"
                if f.name in frame.columns
                else f"cast(NULL AS {f.dataType.simpleString()}) AS `{f.name}`"
                for f in schema
            ],
            *[f"`{c}`" for c in extra],
        )
    return Tables(frames)
