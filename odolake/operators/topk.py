"""The first rows of every key in an order, where a key may hold any share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.session import settle

#: Rows that are ranked together, about.
SLICE_ROWS = 65_536


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, exactly; ``order`` should leave no two rows equal.

    What is among the first k of a key is among the first k of any part of it. So a key with more than ``slice_rows`` rows is
    dealt into slices by a hash of the row, each slice keeps its first k, and what is left is dealt again, until every
    key fits one slice. A round leaves k of ``slice_rows`` rows, so there are few; one number a round comes to the driver.
    Rows that agree in all columns share a slice. A key with NULL in it is a key like others; ``k`` of 0 or less gives no rows.
    """
    if k <= 0:
        return df.where(F.lit(False))
    room = max(slice_rows, 4 * k)
    kept = settle(df)
    while True:
        sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        largest = sizes.agg(F.max("_n")).first()[0] or 0
        if largest <= room:
            return _first(kept, keys, order, k)
        over = sizes.where(F.col("_n") > room).select(*[F.col(c).alias(f"_{c}") for c in keys], F.ceil(F.col("_n") / room).alias("_parts"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
        dealt = kept.join(over, same, "left").drop(*[f"_{c}" for c in keys])
        part = F.pmod(F.xxhash64(*kept.columns), F.coalesce("_parts", F.lit(1)).cast("long"))
        left = settle(_first(dealt.withColumn("_part", part), [*keys, "_part"], order, k).select(*kept.columns))
        if left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] >= largest:
            # Only rows without any difference are left to deal.
            return _first(left, keys, order, k)
        kept = left


def _first(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
