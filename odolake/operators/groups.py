"""Connected groups of a link table by random contraction.

In a round every node moves to the neighbour (or stays) that draws the lowest number, nodes that moved to the same one become one,
and the links between what is left go on. The draws are new in every round, so a long chain loses a constant share of its nodes
each time and the rounds grow with the logarithm of the longest chain, whatever the order of its numbers. A node with very
many links is aggregated before the shuffle; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.session import settle


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); nodes that reach each other have the same root, one of them.

    NULL ends and loops are left out; repeated links change nothing.
    """
    open_ = settle(_plain(links.select("a", "b")))
    labels, turn = None, 0
    while not open_.isEmpty():
        turn += 1
        both = open_.union(open_.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("draw"), F.col("b").alias("to")))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("draw"), F.col("a").alias("to"))
        moved = settle(both.groupBy("a").agg(lowest.alias("_low")).select(F.col("a").alias("node"), F.least("_low", own)["to"].alias("root")))
        labels = moved if labels is None else settle(_relabelled(labels, moved))
        ends = [moved.toDF(end, f"_{end}") for end in ("a", "b")]
        open_ = settle(_plain(open_.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))))
    return open_.select(F.col("a").alias("node"), F.col("b").alias("root")) if labels is None else labels


def _plain(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _relabelled(labels: DataFrame, moved: DataFrame) -> DataFrame:
    now = moved.toDF("root", "_next")
    return labels.join(now, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
