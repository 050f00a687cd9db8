"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are scaled to length one, projected on Gaussian directions, shifted and cut into cells of width ``WIDTH``; the cells of
``PROJECTIONS`` directions make one table's bucket, in ``TABLES`` tables. At cosine 0.93, which is a distance of 0.374, one
direction agrees with probability 0.85 and a pair shares some table's bucket in 99.7 of 100 cases, closer pairs more often;
unrelated vectors share one once in 100,000 times a table. Vectors of a shared bucket are compared exactly, in double
precision, and each pair counts in the first table that it shares.

Equal vectors of a label are one class before hashing. A bucket is dealt into blocks of about ``BLOCK`` vectors, and a task
compares two blocks, so no bucket is ever gathered as a whole. Counts and smallest partners leave a task, not pairs.

Defined cases: a null label, a null or empty vector, one of zeros, or one with a null or non-finite component links with nothing;
neither do vectors of different length. A null vec_id is returned with a null component, is kept and is not compared. Rows that
repeat a vec_id are one vector if label and vector are equal, else the vector
with the smallest hash stands for the vec_id. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm import meetings
from odolake.llm.common import kept
from odolake.llm.components import components
from odolake.llm.kernels import MULTIPLIERS, SALTS, mix, signed

COSINE, WIDTH, PROJECTIONS, TABLES, BLOCK, SEED = 0.93, 2.0, 16, 72, 512, 11


def _directions(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64([SEED, size]))
    return rng.standard_normal((size, TABLES * PROJECTIONS)), rng.uniform(0, WIDTH, TABLES * PROJECTIONS)


def _hashed(batches):
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        node, label = batch.column("node").to_numpy(), batch.column("label").to_numpy()
        rows = batch.column("vector").to_pylist()
        keys = np.zeros((len(rows), TABLES), np.uint64)
        sizes = np.array([len(r) for r in rows], np.int64)
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            x = np.array([rows[i] for i in at], float)
            x /= np.linalg.norm(x, axis=1)[:, None]
            if size not in made:
                made[size] = _directions(size)
            directions, shifts = made[size]
            cells = np.floor((x @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(at), TABLES, PROJECTIONS)
            keys[at] = mix((cells * MULTIPLIERS[:PROJECTIONS]).sum(axis=2, dtype=np.uint64) + SALTS[:TABLES] + np.uint64(size))
        keys = mix(keys + mix(label.astype(np.int64).view(np.uint64))[:, None])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * TABLES, pa.int32()), pa.array(signed(keys.ravel())))
        yield pa.RecordBatch.from_arrays([pa.array(node), lists], ["node", "keys"])


def _linked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine of ``COSINE`` and more; every pair's products are summed in the same order, whatever its block."""
    a, b = np.nonzero(x @ y.T >= COSINE - 1e-9)
    good = [(x[a[i : i + 8192]] * y[b[i : i + 8192]]).sum(axis=1) >= COSINE for i in range(0, len(a), 8192)]
    keep = np.concatenate(good) if good else np.zeros(0, bool)
    return a[keep], b[keep]


def _compared(batches):
    """Links of the meetings, each found first in its own table: node, links, a node it is connected with."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def work(rows: pa.Table, s: int, e: int) -> None:
        part = rows.slice(s, e - s)
        t, low, high = (part.column(c)[0].as_py() for c in ("t", "low", "high"))
        block, node, copies = (part.column(c).to_numpy() for c in ("block", "node", "copies"))
        vectors = part.column("vector").combine_chunks()
        at, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        keys = part.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), TABLES)[:, :t]
        for size in np.unique(np.diff(at)).tolist():
            own = np.flatnonzero(np.diff(at) == size)
            x = values[(at[own][:, None] + np.arange(size)).ravel()].reshape(len(own), size)
            x = x / np.linalg.norm(x, axis=1)[:, None]
            if low == high:
                a, b = _linked(x, x)
                a, b = own[a[a < b]], own[b[a < b]]
            else:
                left, right = np.flatnonzero(block[own] == low), np.flatnonzero(block[own] == high)
                a, b = _linked(x[left], x[right])
                a, b = own[left[a]], own[right[b]]
            fresh = [~(keys[a[i : i + 8192]] == keys[b[i : i + 8192]]).any(axis=1) for i in range(0, len(a), 8192)]
            keep = np.concatenate(fresh) if fresh else np.zeros(0, bool)
            a, b = a[keep], b[keep]
            if len(a):
                out.extend([(node[a], copies[b], node[b]), (node[b], copies[a], node[a])])

    def flush():
        if out:
            node, n, other = (np.concatenate(c) for c in zip(*out, strict=True))
            out.clear()
            # What a task has found of a node leaves as one row: its links, and the root of a star over all it is connected with.
            nodes, roots = meetings.stars(node, other)
            total = np.bincount(np.searchsorted(nodes, node), n, len(nodes)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(total), pa.array(roots)], ["node", "n", "other"])

    yield from meetings.streamed(batches, ["t", "key"], 4 * BLOCK, work, flush)


def near_embeddings(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id: long, embedding: array of numbers, label: integer)."""
    given = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("long").alias("label"))
    finite = F.expr("forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < 'Infinity'::double) AND exists(vector, x -> x <> 0)")
    usable = F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    # Negative zero equals zero.
    rows = given.withColumn("usable", usable).withColumn("vector", F.expr("transform(vector, x -> x + 0.0D)"))
    good = rows.where("usable").withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64(F.lit(SEED), "vector", "label"))
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    placed = kept(rows.where("NOT usable").selectExpr("vec_id", "NULL AS node", "0L AS copies").union(good.join(classes, ["h1", "h2"]).select("vec_id", "node", "copies")))
    chosen = classes.groupBy("node").agg(F.min("h1").alias("h1")).join(classes, ["node", "h1"])
    heads = good.join(chosen, ["h1", "h2"]).where("vec_id = node")
    heads = kept(heads.select("node", "copies", "label", "vector", "h1").dropDuplicates(["node", "h1"]).drop("h1"))
    keys = kept(heads.select("node", "label", "vector").mapInArrow(_hashed, "node long, keys array<long>"))
    buckets = keys.select("node", F.posexplode("keys").alias("t", "key"))
    full = buckets.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1")
    members = buckets.join(full, ["t", "key"]).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows_met = meetings.dealt(members, ["t", "key"], "blocks").join(heads.select("node", "copies", "vector"), "node").join(keys, "node")
    partners = kept(meetings.in_order(rows_met, ["t", "key"]).mapInArrow(_compared, "node long, n long, other long"))
    counts = partners.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(partners.select(F.col("node").alias("a"), F.col("other").alias("b")))
    out = placed.join(counts, "node", "left").join(roots, "node", "left").withColumn("component_id", F.coalesce("root", "node", "vec_id"))
    return out.select(
        "vec_id", (F.coalesce("n", F.lit(0)) + F.greatest(F.col("copies") - 1, F.lit(0))).cast("long").alias("n_links"),
        "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
