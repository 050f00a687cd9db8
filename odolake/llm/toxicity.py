"""Toxicity by nearest labelled examples under exact TF-IDF cosine, found in a block-max inverted index.

Terms are runs of letters (ASCII folded to lower case). Document frequencies, by label, are gathered from a bounded sample of
``SAMPLE`` training rows, in the order of a hash; the index keeps the ``TERMS`` terms that tell the labels apart best, by a chi-squared of ``TELLING`` and more, at least ``LEAST`` times seen. A text is
the vector of (1 + ln count) * ln((N + 1) / (df + 1)) over these terms, of length one, and texts are compared by exact
cosine over it. Examples are rows of that sample: of one half of them, told by a hash, the first ``EXAMPLES`` with a
vector of either label in the order of the hash. They are sorted by their heaviest terms and laid out in
blocks of ``LANES`` as posting blocks with their maxima; a query looks at the blocks with the highest bounds first, then at
those whose bound reaches its ``NEAREST``-th best cosine so far. So the nearest are exact.

Neighbours vote by 1 / (1 - cosine + ``SOFT``), examples weighing what their label's share among the training rows asks for. The
votes of all training rows of the other half calibrate by isotonic regression what a vote means. Evidence: the doc_ids and
cosines of the ``SHOWN`` nearest, and the query's heaviest terms.

The index is broadcast; it has at most 2 * EXAMPLES rows, TERMS terms and 2 * EXAMPLES * TERMS weights.

Defined cases: a text without any of the terms, null and empty ones included, is nearest to nothing and gets the rate of
training rows like it. Labels other than 0 and 1, or none, are not learnt from; nor is a doc_id labelled both ways. Without labels, or with one class only, the score is the share of label 1, 0 without any. A null doc_id is scored,
isn't held out and has no label. Repeated rows are scored alike. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import holds_out, kept, short_batches, slices
from odolake.llm.isotonic import pooled

MODULUS, REMAINDER, THRESHOLD = 4, 2, 0.3
SAMPLE, TERMS, LEAST, EXAMPLES, LANES, NEAREST, SHOWN, SOFT, BINS, SEED = 200_000, 1024, 5, 2048, 64, 15, 3, 0.02, 200, 3
_FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Chi-squared below which a term's difference between labels may be chance, among as many terms as texts have.
TELLING = 24.0
#: Terms a task counts before it hands them on, and the longest term, in bytes.
HELD, LONGEST = 500_000, 64


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLDED).split() if text else []


def _labelled(batch: pa.RecordBatch, ids: np.ndarray, ys: np.ndarray) -> tuple[pa.RecordBatch, np.ndarray]:
    """The rows whose doc_id is among ``ids``, in order, and their labels."""
    doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
    at = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
    hit = (ids[at] == doc) & ~batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
    return batch.filter(pa.array(hit)), ys[at[hit]]


def _frequencies(batches, ids: np.ndarray, ys: np.ndarray):
    """(term, ones, zeros): how many training texts of either label hold a term."""
    held: tuple[Counter, Counter] = (Counter(), Counter())

    def rows():
        ones, zeros = held
        names = [t for t in {**ones, **zeros} if len(t) <= LONGEST]
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array([ones[t] for t in names], pa.int64()), pa.array([zeros[t] for t in names], pa.int64())], ["term", "ones", "zeros"])
        ones.clear()
        zeros.clear()
        return out

    for whole in batches:
        batch, labels = _labelled(whole, ids, ys)
        for text, y in zip(batch.column("text").to_pylist(), labels.tolist(), strict=True):
            held[0 if y else 1].update(set(terms(text)))
            if len(held[0]) + len(held[1]) > HELD:
                yield rows()
    yield rows()


class Vocabulary:
    def __init__(self, names: list[bytes], df: np.ndarray, n: int):
        self.number = {t: i for i, t in enumerate(names)}
        self.names, self.idf = names, np.log((n + 1) / (df + 1))

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Term numbers, in order, and weights; the weights' length is one unless there are none."""
        number = self.number
        found = Counter(t for t in terms(text) if t in number)
        at = np.array(sorted(number[t] for t in found), np.int64)
        if not len(at):
            return at, np.zeros(0)
        w = (1 + np.log([found[self.names[i]] for i in at.tolist()])) * self.idf[at]
        length = math.sqrt(float((w * w).sum()))
        return (at, w / length) if length > 0 else (at[:0], np.zeros(0))


class BlockMaxIndex:
    """Posting blocks of ``LANES`` examples: the weights of a term in a block, one for each lane, and their maximum."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], size: int):
        # Examples with the same heaviest terms share blocks, so the bounds are tight.
        lead = [tuple(at[np.argsort(-w, kind="stable")][:4].tolist()) for at, w in vectors]
        self.order = sorted(range(len(vectors)), key=lambda i: (lead[i], i))
        self.blocks = -(-len(vectors) // LANES)
        tiles: dict[tuple[int, int], np.ndarray] = {}
        for place, i in enumerate(self.order):
            for t, w in zip(*(x.tolist() for x in vectors[i]), strict=True):
                tiles.setdefault((t, place // LANES), np.zeros(LANES))[place % LANES] = w
        self.tile = np.zeros((size, self.blocks), np.int32)
        self.tiles = np.zeros((len(tiles) + 1, LANES))
        for k, ((t, b), w) in enumerate(tiles.items(), 1):
            self.tile[t, b], self.tiles[k] = k, w
        self.most = self.tiles.max(1)[self.tile]

    def _scores(self, at: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        out = np.zeros((len(blocks), LANES))
        for t, x in zip(at.tolist(), w.tolist(), strict=True):
            out += x * self.tiles[self.tile[t, blocks]]
        return out

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int = NEAREST) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines above 0 of the k nearest; equal ones in the examples' order in the index."""
        bound = w @ self.most[at]
        by_bound = np.argsort(-bound, kind="stable")
        first = by_bound[: max(1, -(-k // LANES) + 1)]
        scores, blocks = self._scores(at, w, first), first
        least = np.partition(scores.ravel(), -k)[-k] if scores.size >= k else 0.0
        rest = by_bound[len(first) :]
        rest = rest[bound[rest] >= least - 1e-12]
        rest = rest[bound[rest] > 0]
        if len(rest):
            scores, blocks = np.concatenate((scores, self._scores(at, w, rest))), np.concatenate((blocks, rest))
        place, score = (blocks[:, None] * LANES + np.arange(LANES)).ravel(), scores.ravel()
        if len(score) > k:
            cut = np.partition(score, -k)[-k]
            good = score >= cut
            place, score = place[good], score[good]
        good = (score > 1e-12) & (place < len(self.order))
        place, score = place[good], score[good]
        best = np.lexsort((place, -score))[:k]
        return place[best], np.minimum(score[best], 1.0)


def vote(cosines: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    x = weights / (1 - cosines + SOFT)
    return float((x * labels).sum() / x.sum())


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = MODULUS, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row; learns from labels (doc_id, toxic) of rows not held out."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    valid = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~holds_out("doc_id", modulus, remainder))
    marked = kept(valid.groupBy("doc_id").agg(F.min("toxic").cast("int").alias("y"), F.max("toxic").alias("_h")).where("y = _h").drop("_h"))
    hashed = F.xxhash64("doc_id", F.lit(SEED))
    sample = marked.select("doc_id", "y").orderBy(hashed, "doc_id").limit(SAMPLE).toArrow().sort_by("doc_id")
    n, ones = sample.num_rows, int(sample["y"].to_numpy().sum())
    if n == 0 or ones in (0, n):
        plain = docs.select("doc_id", F.lit(ones / n if n else 0.0).alias("score"), F.lit(None).cast("string").alias("evidence"))
        return _answer(plain, modulus, remainder)
    learnt = docs.sparkSession.sparkContext.broadcast((sample["doc_id"].to_numpy(), sample["y"].to_numpy().astype(np.int64)))
    df = docs.mapInArrow(lambda batches: _frequencies(batches, *learnt.value), "term binary, ones long, zeros long").groupBy("term").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
    p, q = float(ones), float(n - ones)
    # Chi-squared of the table (holds the term or not, label 1 or 0).
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (a * (q - b) - b * (p - a)) ** 2 * n / (p * q * (a + b) * (n - a - b + 0.5))
    best = df.where(f"a + b >= {LEAST}").withColumn("chi", chi).where(f"chi >= {TELLING}").orderBy(F.desc("chi"), "term").limit(TERMS).collect()
    if not best:
        plain = docs.select("doc_id", F.lit(ones / n).alias("score"), F.lit(None).cast("string").alias("evidence"))
        return _answer(plain, modulus, remainder)
    vocabulary = Vocabulary([bytes(r["term"]) for r in best], np.array([r["a"] + r["b"] for r in best], float), n)

    def reduced(batches):
        for whole in batches:
            batch, ys = _labelled(whole, *learnt.value)
            found = [vocabulary.vector(t) for t in batch.column("text").to_pylist()]
            columns = [pa.array(ys, pa.int32()), pa.array([f[0].tolist() for f in found], pa.list_(pa.int64())), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "y", "at", "w"])

    half = docs.where(hashed % 2 == 0).mapInArrow(reduced, "doc_id long, y int, at array<long>, w array<double>")
    half = kept(half.where("size(at) > 0"))
    vectors, known, ids = [], [], []
    for y in (0, 1):
        rows = half.where(f"y = {y}").orderBy(F.xxhash64("doc_id", F.lit(SEED + 1)), "doc_id").limit(EXAMPLES).collect()
        rows.sort(key=lambda r: (r["doc_id"], r["at"]))
        vectors += [(np.array(r["at"], np.int64), np.array(r["w"])) for r in rows]
        known += [y] * len(rows)
        ids += [r["doc_id"] for r in rows]
    shares = {y: max(1, known.count(y)) for y in (0, 1)}
    index = BlockMaxIndex(vectors, len(best))
    order = np.array(index.order, np.int64)
    y_of = np.array(known, float)[order] if len(order) else np.zeros(0)
    w_of = np.where(y_of > 0, p / n / shares[1], q / n / shares[0])
    model = docs.sparkSession.sparkContext.broadcast((vocabulary, index, y_of, w_of, np.array(ids, np.int64)[order] if len(order) else np.zeros(0, np.int64)))

    def voted(batches):
        vocabulary, index, y_of, w_of, id_of = model.value
        memo: dict[bytes, tuple[int, str | None]] = {}
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                bins, evidence = [], []
                for text in batch.column("text").to_pylist():
                    at, w = vocabulary.vector(text)
                    key = at.tobytes() + w.tobytes()
                    if key not in memo:
                        if len(memo) >= 20_000:
                            memo.clear()
                        memo[key] = (BINS, None)
                        if len(at) and index.blocks:
                            place, cosine = index.nearest(at, w)
                            if len(place):
                                v = vote(cosine, y_of[place], w_of[place])
                                shown = ", ".join(f"{id_of[i]}:{c:.4f}" for i, c in zip(place[:SHOWN], cosine, strict=False))
                                heavy = " ".join(vocabulary.names[i].decode(errors="replace") for i in at[np.argsort(-w, kind="stable")][:5])
                                memo[key] = (min(int(v * BINS), BINS - 1), f"{shown} | {heavy}")
                    b, e = memo[key]
                    bins.append(b)
                    evidence.append(e)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bins, pa.int32()), pa.array(evidence, pa.string())], ["doc_id", "bin", "evidence"])

    votes = kept(docs.mapInArrow(voted, "doc_id long, bin int, evidence string"))
    counted = votes.join(marked, "doc_id").where(hashed % 2 != 0).groupBy("bin").agg(F.sum("y").alias("p"), F.count("*").alias("n")).collect()
    positives, totals = np.zeros(BINS + 1), np.zeros(BINS + 1)
    for r in counted:
        positives[r["bin"]], totals[r["bin"]] = r["p"], r["n"]
    base = p / n
    rates = pooled(positives[:BINS], totals[:BINS]) if totals[:BINS].sum() else (np.arange(BINS) + 0.5) / BINS
    silent = (positives[BINS] + base) / (totals[BINS] + 1)
    rate = F.element_at(F.array(*[F.lit(float(x)) for x in [*rates, silent]]), F.col("bin") + 1)
    return _answer(votes.select("doc_id", rate.alias("score"), "evidence"), modulus, remainder)


def _answer(scored: DataFrame, modulus: int, remainder: int) -> DataFrame:
    return scored.select("doc_id", holds_out("doc_id", modulus, remainder).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")
