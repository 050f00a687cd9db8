"""Verified links between the members of hash buckets, without listing all pairs of a bucket.

A bucket's members are first compared with its hub, which joins true near copies in one step. Where a bucket then still holds
several components, the members of all such buckets of a hub meet: they are dealt into blocks of bounded size, and a task
compares two blocks. There sketches, or the marks given, leave out what is far from similar (a pair at the limit is left out once in ten million
times) and the full sets decide on the rest. A task hands on one star for each component it finds, not pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm import meetings
from odolake.llm.bitmap import bitmap, maybe
from odolake.llm.common import kept
from odolake.llm.components import components
from odolake.llm.sketch import COORDINATES, fast_sketch

#: Members and items of a block.
BLOCK, ITEMS = 768, 1_500_000
#: Rows a task holds before it works on the complete meetings among them.
HELD = 1024
#: Pairs of marks compared at once, about.
PAIRS = 100_000


#: Whether two nodes may be near: of two arrays of marks, row by row.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Turns a column of items into arrays of distinct, sorted hashes.
SetsOf = Callable[[pa.Array], list[np.ndarray]]


def list_sets(column: pa.Array) -> list[np.ndarray]:
    """Of lists of distinct, sorted hashes."""
    at, values = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _near(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * common items >= percent * items of both together."""
    both = np.concatenate((x, y))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, sets_of: SetsOf = list_sets) -> DataFrame:
    """Of (a, b), those with 100 * common items >= percent * items of both together; ``sets``: node, items, n."""

    def confirm(batches):
        for batch in batches:
            left, right = (sets_of(batch.column(c)) for c in ("left", "right"))
            keep = []
            for x, y in zip(left, right, strict=True):
                keep.append(_near(x, y, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.toDF("b", "right", "rn"), "b").join(sets.toDF("a", "left", "ln"), "a")
    near = both.where(F.least("ln", "rn") * 100 >= percent * F.greatest("ln", "rn"))
    return near.select("a", "b", "left", "right").mapInArrow(confirm, "a long, b long")


def near_components(keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, sets_of: SetsOf = list_sets, given: DataFrame | None = None, alike: Alike | None = None) -> DataFrame:
    """(node, root) of nodes linked to others, from (node, keys): a node's hash buckets, all longs.

    ``fetch`` gives (node, items, n) for a table of distinct nodes: what ``sets_of`` makes a set of, and that set's size. Nodes that share
    no bucket with others are never fetched. Repeated rows change nothing. ``given`` are links (a, b) that hold anyway.
    With ``alike``, ``keyed`` has a node's mark too, and only nodes are fetched that a shared hub and their marks bring together.
    """
    buckets = keyed.select(F.explode("keys").alias("bucket"), "node")
    # The hub is the smallest node, so a node's buckets have few different ones.
    full = kept(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("_h")).where("hub < _h").drop("_h"))
    bits = keyed.sparkSession.sparkContext.broadcast(bitmap(full, "bucket", hashed=False))

    def pick(batches):
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            node = np.repeat(batch.column("node").to_numpy(), lists.value_lengths().to_numpy())
            hit = maybe(bits.value, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(node[hit])], ["bucket", "node"])

    shared = kept(keyed.select("node", "keys").mapInArrow(pick, "bucket long, node long").join(full, "bucket"))
    stars = kept(shared.where("node <> hub").selectExpr("node AS b", "hub AS a").distinct())
    return _linked(shared, stars, keyed, fetch, percent, sets_of, given, alike)


def near_nodes(stars: DataFrame, marks: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, sets_of: SetsOf, alike: Alike) -> DataFrame:
    """As ``near_components``, from the distinct nodes b of every hub a that were left of a first comparison, and (node, mark) of all nodes."""
    stars = kept(stars.where("a <> b").distinct())
    # All nodes of a hub are taken for one bucket.
    return _linked(stars.selectExpr("a AS bucket", "b AS node", "a AS hub"), stars, marks, fetch, percent, sets_of, None, alike)


def _linked(shared: DataFrame, stars: DataFrame, keyed: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, sets_of: SetsOf, given: DataFrame | None, alike: Alike | None) -> DataFrame:
    nodes, marks = stars.selectExpr("a AS node").union(stars.select("b")).distinct(), None
    if alike:
        marks = kept(keyed.select("node", "mark").join(nodes, "node", "left_semi").dropDuplicates(["node"]))
        mates = _mates(stars, marks, components(likely := kept(_alike(stars, marks, alike))), alike)
        nodes = kept(likely.selectExpr("a AS node").union(likely.select("b")).union(mates).distinct())
        stars, shared = likely, kept(shared.join(nodes, "node", "left_semi"))
    sets = kept(fetch(nodes))
    first = stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = verified(first, sets, percent, sets_of)
    links = kept(links if given is None else links.union(given))
    links = kept(links.union(verified(_apart(stars, components(links)), sets, percent, sets_of)))
    roots = components(links)
    found = kept(_met(shared, sets, roots, percent, sets_of, marks, alike))
    return roots if found.isEmpty() else components(links.union(found))


def _words(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().view(np.uint64).reshape(len(column), -1)


def _alike(pairs: DataFrame, marks: DataFrame, alike: Alike) -> DataFrame:
    """Of (b, a), those whose marks don't rule them out."""

    def confirm(batches):
        for batch in batches:
            if batch.num_rows:
                keep = alike(_words(batch.column("right")), _words(batch.column("left")))
                yield pa.RecordBatch.from_arrays([batch.column("b"), batch.column("a")], ["b", "a"]).filter(pa.array(keep))

    both = pairs.join(marks.toDF("b", "right"), "b").join(marks.toDF("a", "left"), "a")
    return both.select("b", "a", "right", "left").mapInArrow(confirm, "b long, a long")


def _mates(stars: DataFrame, marks: DataFrame, roots: DataFrame, alike: Alike) -> DataFrame:
    """Nodes whose mark is like that of one of their hub's other nodes, where the two have different roots."""
    placed = stars.toDF("node", "hub").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    totals = placed.groupBy("hub").agg(F.count("*").alias("c"), F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l < _h")
    own = placed.join(totals.select("hub", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "hub")
    rows = meetings.dealt(own, ["hub"], "blocks").join(marks, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    def compared(batches):
        for met, edges in meetings.complete(batches, ["hub"], HELD):
            found = np.concatenate([np.zeros(0, np.int64), *(x for pair in _pairs(met, edges, alike) for x in pair)])
            node = met.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(node[found]))], ["node"])

    return meetings.in_order(rows, ["hub"]).mapInArrow(compared, "node long")


def _pairs(met: pa.Table, edges: list[int], alike: Alike) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the same meeting, two by two, that have different roots and are alike by their marks."""
    root, block, low, high = (met.column(c).to_numpy() for c in ("root", "block", "low", "high"))
    mark = _words(met.column("mark").combine_chunks())
    at = np.array(edges, np.int64)  # only 0 where no meeting is complete yet
    later = np.repeat(at[1:], np.diff(at)) - np.arange(at[-1]) - 1
    part = np.cumsum(later) // PAIRS
    for rows in np.split(np.arange(at[-1]), np.flatnonzero(part[1:] != part[:-1]) + 1):
        left = np.repeat(rows, later[rows])
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(later[rows]) - later[rows], later[rows])
        ok = (root[left] != root[right]) & ((low[left] == high[left]) | (block[left] != block[right]))
        left, right = left[ok], right[ok]
        ok = alike(mark[left], mark[right])
        yield left[ok], right[ok]


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    placed = pairs.join(a, "a", "left").join(b, "b", "left")
    return placed.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b")


def _met(shared: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, sets_of: SetsOf, marks: DataFrame | None = None, alike: Alike | None = None) -> DataFrame:
    """Links (a, b) that join the components which share buckets, found without the hubs."""
    placed = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    still = placed.groupBy("bucket").agg(F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l < _h").select("bucket")
    # The hub itself has been compared with all of them.
    groups = placed.join(still, "bucket").where("node <> hub").groupBy("hub", "node", "root").agg(F.lit(1)).select("hub", "node", "root")
    sized = groups.join(sets.select("node", "n"), "node")
    totals = sized.groupBy("hub").agg(F.count("*").alias("c"), F.sum("n").alias("t"), F.min("root").alias("_l"), F.max("root").alias("_h")).where("_l < _h")
    blocks = totals.select("hub", F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("t") / ITEMS)).cast("int").alias("blocks"))
    own = kept(groups.join(blocks, "hub"))
    hubs = own.groupBy("node", "root").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))  # as many as a node has buckets
    rows = meetings.dealt(own, ["hub"], "blocks").join(hubs, "node").join(sets.select("node", "items"), "node")

    def compared(batches):
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def work(rows: pa.Table, s: int, e: int) -> None:
            part = rows.slice(s, e - s)
            node, root, block = (part.column(c).to_numpy() for c in ("node", "root", "block"))
            low, high, hub = (part.column(c)[0].as_py() for c in ("low", "high", "hub"))
            lists = sets_of(part.column("items").combine_chunks())
            n = np.array([len(x) for x in lists], np.int64)
            left = np.flatnonzero(block == low)
            right = left if low == high else np.flatnonzero(block == high)
            if not len(left) or not len(right) or root.min() == root.max():
                return
            ok = (root[left][:, None] != root[right][None, :]) & (np.minimum(n[left][:, None], n[right][None, :]) * 100 >= percent * np.maximum(n[left][:, None], n[right][None, :]))
            if low == high:
                ok &= np.arange(len(left))[:, None] < np.arange(len(right))[None, :]
            if np.count_nonzero(ok) > 64:
                used = np.unique(np.concatenate((left[ok.any(1)], right[ok.any(0)])))
                sketches = np.zeros((len(node), COORDINATES), np.uint32)
                for i in used.tolist():
                    sketches[i] = fast_sketch(lists[i]).astype(np.uint32)
                agree = np.zeros(ok.shape, np.uint8)
                for k in range(COORDINATES):
                    agree += sketches[left, k][:, None] == sketches[right, k][None, :]
                ok &= agree >= COORDINATES * (percent / 100 - 0.2)
            pairs = np.nonzero(ok)
            a, b = left[pairs[0]], right[pairs[1]]
            if not len(a):
                return
            met = part.column("hubs").to_pylist()
            known, codes = np.unique(np.concatenate(lists), return_inverse=True)
            at = np.concatenate(([0], np.cumsum(n)))
            flag = np.zeros(len(known), np.int64)
            out = []
            for i in np.unique(a).tolist():
                # A pair that shares an earlier hub is compared there.
                before = {h for h in met[i] if h < hub}
                mates = [j for j in b[a == i].tolist() if before.isdisjoint(met[j])]
                if not mates:
                    continue
                flag[codes[at[i] : at[i + 1]]] = 1
                common = [int(flag[codes[at[j] : at[j + 1]]].sum()) for j in mates]
                flag[codes[at[i] : at[i + 1]]] = 0
                out += [(node[i], node[j]) for j, c in zip(mates, common, strict=True) if 100 * c >= percent * (n[i] + n[j] - c)]
            if out:
                found.append((np.array([x for x, _ in out], np.int64), np.array([y for _, y in out], np.int64)))

        def flush():
            if found:
                a, b = meetings.stars(*(np.concatenate(c) for c in zip(*found, strict=True)))
                found.clear()
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        yield from meetings.streamed(batches, ["hub"], HELD, work, flush)

    def compared_by_marks(batches):
        for met, edges in meetings.complete(batches, ["hub"], HELD):
            a, b = (np.concatenate(x) for x in zip(*_pairs(met, edges, alike), strict=True))
            node, hub, n = (met.column(c).to_numpy() for c in ("node", "hub", "n"))
            ok = np.minimum(n[a], n[b]) * 100 >= percent * np.maximum(n[a], n[b])
            a, b = a[ok], b[ok]
            used, at = np.unique(np.concatenate((a, b)), return_inverse=True)
            if not len(used):
                continue
            part = met.take(pa.array(used))
            hubs = [set(x) for x in part.column("hubs").to_pylist()]
            lists = sets_of(part.column("items").combine_chunks())
            out = []
            for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
                # A pair that shares an earlier hub is compared there.
                if min(hubs[i] & hubs[j]) == hub[used[i]] and _near(lists[i], lists[j], percent):
                    out.append((node[used[i]], node[used[j]]))
            if out:
                a, b = meetings.stars(*np.array(out, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    if alike:
        rows = rows.join(sets.select("node", "n"), "node").join(marks, "node")
    return meetings.in_order(rows, ["hub"]).mapInArrow(compared_by_marks if alike else compared, "a long, b long").where("a <> b")
