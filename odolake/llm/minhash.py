"""MinHash near-dedup by fast similarity sketching.

A document is the set of its distinct five-word shingles. Its sketch of 128 coordinates (``sketch``) is banded by ``ROWS``; what
shares a band is confirmed on the full sets. At similarity 0.75 a pair misses all 32 bands once in 200,000 times.

Defined cases: null and empty texts and texts of white space have an empty set and are linked with nothing. Equal sets
are one class before banding, so thousands of copies cost one comparison. Rows that repeat a doc_id are one document,
linked with whatever one of its texts links; each row is returned. A null doc_id has no links, a null component and is kept. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.bitmap import bitmap, maybe
from odolake.llm.common import kept, short_batches, slices
from odolake.llm.kernels import MULTIPLIERS, SALTS, mix, shingle_sets, signed
from odolake.llm.links import near_components
from odolake.llm.sketch import COORDINATES, fast_sketch

WORDS, PERCENT = 5, 75
ROWS = 4


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(-1, ROWS)
    return mix((rows * MULTIPLIERS[:ROWS]).sum(axis=1, dtype=np.uint64) + SALTS[: len(rows)])


def _sketched(batches):
    """doc_id, set size, a 128-bit digest of the set, and the band keys."""
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"), WORDS)
            digests = np.zeros((len(sets), 2), np.uint64)
            keys: list[np.ndarray] = []
            for i, s in enumerate(sets):
                if len(s):
                    digests[i, 0] = mix(s ^ SALTS[1000]).sum(dtype=np.uint64)
                    digests[i, 1] = mix(s ^ SALTS[1001]).sum(dtype=np.uint64)
                    keys.append(band_keys(fast_sketch(s)))
            full = np.array([len(s) > 0 for s in sets], np.int64) * (COORDINATES // ROWS)
            values = signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(full))), pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(signed(digests[:, 0].copy())), pa.array(signed(digests[:, 1].copy())), lists],
                ["doc_id", "n_shingles", "d1", "d2", "keys"],
            )


def shingle_items(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, items, n) of the documents listed in ``nodes``; a bitmap keeps most others from being hashed and moved."""
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(nodes, "node"))

    def pick(batches):
        for whole in batches:
            hit = maybe(bits.value, whole.column("place").to_numpy(zero_copy_only=False))
            for batch in slices(whole.filter(pa.array(hit)), "text"):
                sets = shingle_sets(batch.column("text"), WORDS)
                ends = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                items = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(sets))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), items, pa.array(np.diff(ends))], ["node", "items", "n"])

    placed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("doc_id").alias("place"))
    return placed.mapInArrow(pick, "node long, items array<long>, n long").join(nodes, "node", "left_semi")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id: long, text: string)."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sketched = kept(docs.mapInArrow(_sketched, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>"))
    classes = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("node"))
    classed = kept(sketched.join(classes, ["d1", "d2", "n_shingles"], "left").selectExpr("doc_id", "n_shingles", "node", "CASE WHEN doc_id = node THEN keys END AS keys"))
    keyed = classed.where("keys IS NOT NULL").select("node", "keys")
    # Classes that share a doc_id are one document.
    least = classed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("_h")).where("b < _h").drop("_h")
    given = classed.join(least, "doc_id").where("node <> b").selectExpr("node AS a", "b")
    roots = near_components(keyed, lambda nodes: shingle_items(docs, nodes), PERCENT, given=given)
    placed = classed.select("doc_id", "n_shingles", "node").join(roots, "node", "left")
    found = placed.withColumn("component_id", F.coalesce("root", "node", "doc_id"))
    return found.selectExpr("doc_id", "n_shingles", "component_id", "coalesce(doc_id = component_id, true) AS kept")
