"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Each text is described by the numbers of ``statistics``, standardised by the training rows. ``FEATURES`` random cosines
of them approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums, of fixed size, are
added in two steps. Equations are kept for two halves of the training rows, told apart by a hash: a half is scored by
the other's ridge solution, and those scores calibrate by isotonic regression what the solution of both gives.

Defined cases: a null or empty text is described by zeros and scored like any other. Repeated rows are scored alike, and
each counts in training. Labels other than 0 and 1, or none, are not learnt from; a doc_id labelled more than once counts with each
label. Without labels, or with one class only, the score is the share of label 1, 0.5 without any. A null doc_id is
scored, isn't held out and has no label. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import holds_out, kept, short_batches, slices
from odolake.llm.isotonic import pooled
from odolake.llm.statistics import NAMES, describe

FEATURES, RIDGE, BINS, SEED, THRESHOLD = 256, 1e-3, 400, 5, 0.3
MODULUS, REMAINDER = 5, 0
_FAN = 16


class Fourier:
    """The random cosines; bandwidth: the square root of twice the number of statistics."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int = FEATURES):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.spread = mean, np.where(spread > 1e-12, spread, 1.0)
        self.directions = rng.standard_normal((len(mean), features)) / np.sqrt(2 * len(mean))
        self.phases = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack((np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones(len(x))))


def _described(batches):
    for whole in batches:
        for batch in slices(whole, "text"):
            x = describe(batch.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "x"])


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES))


def _added(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Sum, for either half, of the partitions' (half, sums) blobs; ``_FAN`` partial sums of either reach the driver."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b, np.float64) for b in frame["sums"])
        return pd.DataFrame({"half": frame["half"].iloc[:1], "sums": [total.tobytes()]})

    parts = rows.groupBy("half", "turn").applyInPandas(add, "half int, sums binary").collect()
    out = [np.zeros(width), np.zeros(width)]
    for r in parts:
        out[r["half"]] = out[r["half"]] + np.frombuffer(r["sums"], np.float64)
    return out


def _equations(train: DataFrame, features: Fourier) -> list[np.ndarray]:
    d = len(features.phases) + 1

    def summed(batches):
        from pyspark import TaskContext

        total = [np.zeros(d * d + d), np.zeros(d * d + d)]
        for b in batches:
            x, y = features(_matrix(b.column("x"))), b.column("y").to_numpy(zero_copy_only=False).astype(float)
            half = b.column("half").to_numpy(zero_copy_only=False)
            for h in (0, 1):
                own = x[half == h]
                total[h][: d * d] += (own.T @ own).ravel()
                total[h][d * d :] += own.T @ y[half == h]
        turn = TaskContext.get().partitionId() % _FAN
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([turn, turn], pa.int32()), pa.array([t.tobytes() for t in total], pa.binary())], ["half", "turn", "sums"])

    return _added(train.mapInArrow(summed, "half int, turn int, sums binary"), d * d + d)


def _solved(sums: np.ndarray, rows: float) -> np.ndarray:
    d = int((np.sqrt(4 * len(sums) + 1) - 1) / 2)
    a = sums[: d * d].reshape(d, d)
    return np.linalg.solve(a + RIDGE * max(rows, 1.0) / d * np.eye(d) + 1e-9 * np.eye(d), sums[d * d :])


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; learns from labels (doc_id, quality) of rows not held out."""
    short_batches(docs.sparkSession)
    described = kept(docs.select("doc_id", "text").mapInArrow(_described, "doc_id long, x array<double>"))
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("y")).distinct()
    train = described.where(~holds_out("doc_id", modulus, remainder)).join(marked, "doc_id")
    train = kept(train.select("x", "y", (F.xxhash64("doc_id", F.lit(SEED)) % 2 != 0).cast("int").alias("half")))
    width = len(NAMES)
    moments = train.agg(
        F.count("*").alias("n"), F.sum("y").alias("ones"), F.sum("half").alias("second"),
        *[f(F.col("x")[i]).alias(f"{n}{i}") for n, f in (("m", F.avg), ("s", F.stddev_pop)) for i in range(width)],
    ).first()
    n, ones = moments["n"], moments["ones"] or 0
    if n == 0 or ones in (0, n):
        score = F.lit((ones / n) if n else 0.5)
        return _answer(described.withColumn("score", score), modulus, remainder)
    features = Fourier(np.array([moments[f"m{i}"] for i in range(width)]), np.array([moments[f"s{i}"] for i in range(width)]))
    first, second = _equations(train, features)
    halves = [_solved(second, moments["second"]), _solved(first, n - moments["second"])]  # a half is scored by the other
    whole = _solved(first + second, n)

    def place(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.clip(((features(x) @ weights + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)

    def crossed(batches):
        for b in batches:
            x, half = _matrix(b.column("x")), b.column("half").to_numpy(zero_copy_only=False)
            at = np.where(half == 0, place(x, halves[0]), place(x, halves[1]))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column("y")], ["bin", "y"])

    counted = train.mapInArrow(crossed, "bin int, y int").groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    positives, totals = np.zeros(BINS), np.zeros(BINS)
    for r in counted:
        positives[r["bin"]], totals[r["bin"]] = r["p"], r["n"]
    rates = pooled(positives, totals)

    def scored(batches):
        for b in batches:
            at = place(_matrix(b.column("x")), whole)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rates[at])], ["doc_id", "score"])

    return _answer(described.mapInArrow(scored, "doc_id long, score double"), modulus, remainder)


def _answer(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", holds_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
