"""Connected components of an edge table by alternating large and small stars.

Every round works with grouped minima and joins, so a node with very many edges is aggregated before the
shuffle and never collected. Edges are first contracted inside each partition; what then fits one block
needs no rounds and is contracted as one. Rounds are written to the shared folder; a lost executor repeats
one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import kept

#: Links a task contracts at once, whatever their number in all.
BLOCK = 200_000


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace the links of a partition, in blocks, by stars round each smallest node."""
    held, rows = [], 0

    def stars() -> pd.DataFrame:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (up := parent.setdefault(root, root)) != root:
                root = up
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for f in held:
            for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        pairs = [(x, find(x)) for x in parent]
        return pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"], dtype="int64")

    for f in frames:
        held.append(f)
        rows += len(f)
        if rows >= BLOCK:
            yield stars()
            held, rows = [], 0
    if held:
        yield stars()


def _listed(stars: DataFrame) -> DataFrame:
    return stars.selectExpr("a AS node", "b AS root").union(stars.selectExpr("b AS node", "b AS root").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); root is the smallest node it reaches.

    Null ends are left out, repeated links and loops change nothing; a node with only a loop is not listed.
    """
    edges = kept(links.select("a", "b").where("a <> b").mapInPandas(_contracted, "a long, b long"))
    if edges.count() <= BLOCK:
        return _listed(kept(edges.coalesce(1).mapInPandas(_contracted, "a long, b long")))
    state = None
    while True:
        # Large star: what is larger than a node moves to the smallest of the node's neighbours and itself.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(down, "a").selectExpr("b AS a", "m AS b").union(down.selectExpr("a", "m AS b"))
        edges = kept(moved.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return _listed(edges)
        state = now
