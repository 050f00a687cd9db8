"""Groups dealt into blocks, so that a task compares two blocks at a time and never gathers a group as a whole."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dealt(members: DataFrame, group: list[str], blocks: str) -> DataFrame:
    """(group, node, low, high, block): each member in every meeting of its block with a block of its group.

    ``blocks`` is the column with the group's number of blocks; the block of a node follows from its hash.
    """
    placed = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int"))
    met = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1)))
    return met.select(*group, "node", "block", F.least("block", "j").alias("low"), F.greatest("block", "j").alias("high"))


def in_order(rows: DataFrame, group: list[str]) -> DataFrame:
    key = [*group, "low", "high"]
    return rows.repartition(*key).sortWithinPartitions(*key)


def complete(batches: Iterable[pa.RecordBatch], group: list[str], most: int) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of about ``most`` sorted rows that hold whole meetings, with the rows where each meeting begins and the last one ends."""
    held: list[pa.RecordBatch] = []

    def edges(rows: pa.Table, last: bool) -> list[int]:
        new = np.zeros(rows.num_rows - 1, bool)
        for name in [*group, "low", "high"]:
            x = rows.column(name).to_numpy()
            new |= x[1:] != x[:-1]
        return [0, *(np.flatnonzero(new) + 1).tolist(), *([rows.num_rows] if last else [])]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            rows = pa.Table.from_batches(held).combine_chunks()
            at = edges(rows, False)
            yield rows, at
            held = rows.slice(at[-1]).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, edges(rows, True)


def streamed(batches: Iterable[pa.RecordBatch], group: list[str], most: int, work: Callable[[pa.Table, int, int], None], flush: Callable[[], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call ``work(rows, begin, end)`` for every meeting of sorted rows, and ``flush`` after about ``most`` rows."""
    for rows, edges in complete(batches, group, most):
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            work(rows, s, e)
        yield from flush()


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links (a, b), and for each the smallest one it is connected with."""
    nodes = np.unique(np.concatenate((a, b)))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == least).all():
            return nodes, nodes[least]
        least = after
