"""Which bundles to load when several places hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_source(server: DataFrame, card: DataFrame) -> DataFrame:
    """One row per content_root from both places; the server's copy wins.

    The pick is a mergeable aggregate, so however many copies a bundle has they are
    reduced before they are shuffled.
    """
    cols = server.columns
    both = server.withColumn("_source", F.lit(0)).unionByName(card.withColumn("_source", F.lit(1)))
    picked = both.groupBy("content_root").agg(F.min(F.struct("_source", *[c for c in cols if c != "content_root"])).alias("r"))
    return picked.select(*[F.col("content_root") if c == "content_root" else F.col(f"r.{c}").alias(c) for c in cols])
