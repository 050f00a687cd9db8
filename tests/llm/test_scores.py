"""Scores: labels, class bigrams, calibration."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from odolake.llm import brown, isotonic, quality, statistics, toxicity
from tests.llm.helpers import documents, hostile, tuples, words


def area(pairs):
    ones, zeros = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(a > b) + 0.5 * (a == b) for a in ones for b in zeros])


def held(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


@pytest.fixture(scope="module")
def marked(spark):
    """Prose, shouted junk, and insults in some of the prose; every second document is labelled."""
    rng = random.Random(8)
    rows, quality_of, toxic_of = [], {}, {}
    for i in range(700):
        text = words(rng, rng.randrange(20, 120), 600)
        good, toxic = rng.random() < 0.7, rng.random() < 0.2
        if not good:
            text = "!! ".join(text.upper().split())
        if toxic:
            parts = text.split()
            for _ in range(rng.randrange(2, 6)):
                parts.insert(rng.randrange(len(parts)), rng.choice(["Vile,", "rotten", "awful.", "nasty"]))
            text = " ".join(parts)
        rows.append((i, text))
        quality_of[i], toxic_of[i] = int(good), int(toxic)
    labels = [(i, quality_of[i], toxic_of[i]) for i in range(0, 700, 2)] + [(1, None, None), (3, 7, 9), (None, 1, 1), (9999, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return documents(spark, rows), frame, quality_of, toxic_of


def test_quality_separates_rows_that_are_not_labelled(spark, marked):
    docs, labels, truth, _ = marked
    got = tuples(quality.score_quality(docs, labels), "doc_id", "held_out", "score", "predicted")
    assert all(h == held(i, 5, 0) and 0 <= s <= 1 and p == (s >= 0.3) for i, h, s, p in got) and len(got) == 700
    assert area([(s, truth[i]) for i, h, s, _ in got if i % 2]) > 0.97
    assert sum(p != truth[i] for i, _, _, p in got if i % 2) < 20


def test_toxicity_separates_rows_that_are_not_labelled(spark, marked):
    docs, labels, _, truth = marked
    got = tuples(toxicity.score_toxicity(docs, labels), "doc_id", "held_out", "score", "predicted", "evidence")
    assert all(h == held(i, 4, 2) and 0 <= s <= 1 and p == (s >= 0.3) for i, h, s, p, _ in got) and len(got) == 700
    assert area([(s, truth[i]) for i, h, s, _, _ in got if i % 2]) > 0.97
    assert any(e and ":" in e for *_, e in got)


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_scores_of_hostile_tables(spark, score):
    docs, schema = hostile(spark), "doc_id long, quality int, toxic int"
    some = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (6, 1, 0), (7, 0, 1), (8, 1, 0), (8, 0, 1), (9, 1, 1), (10, 0, 0), (11, None, 1)], schema)
    for labels in (some, some.limit(0), some.where("doc_id = 5")):
        got = tuples(score(docs, labels), "doc_id", "held_out", "score", "predicted")
        assert len(got) == 16 and all(0 <= g[2] <= 1 and g[3] == (g[2] >= 0.3) for g in got)
    assert score(documents(spark, []), some).count() == 0


def test_labels_alone_decide_not_other_columns(spark, marked):
    """Held-out labels change nothing."""
    docs, labels, *_ = marked
    flipped = labels.rdd.map(lambda r: (r[0], *(None if x is None else 1 - x if r[0] is not None and zlib.crc32(str(r[0]).encode()) % m == k else x for x, m, k in ((r[1], 5, 0), (r[2], 4, 2)))))
    flipped = spark.createDataFrame(flipped, labels.schema)
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert sorted(tuples(score(docs, labels), "doc_id", "score")) == sorted(tuples(score(docs, flipped), "doc_id", "score"))


def test_pooled_rates_never_fall():
    rates = isotonic.pooled(np.array([0, 3, 1, 0, 9]), np.array([4, 5, 5, 0, 9]))
    assert (np.diff(rates) >= 0).all() and 0 < rates[0] < 0.2 and rates[-1] > 0.9
    assert (isotonic.pooled(np.zeros(3), np.zeros(3)) == 0.5).all()


def test_block_max_index_is_exact():
    rng = np.random.Generator(np.random.PCG64(6))
    dense = rng.random((500, 40)) * (rng.random((500, 40)) < 0.15)
    dense[7] = dense[3]
    dense /= np.maximum(np.linalg.norm(dense, axis=1), 1e-12)[:, None]
    sparse = [(np.flatnonzero(r), r[np.flatnonzero(r)]) for r in dense]
    index = toxicity.BlockMaxIndex(sparse, 40)
    for at, w in sparse[:80]:
        place, score = index.nearest(at, w, 9)
        want = np.sort(dense[:, at] @ w)[::-1][:9]
        assert np.allclose(score, want[want > 1e-12][: len(score)]) and len(score) == min(9, (want > 1e-12).sum())
        assert np.allclose([dense[index.order[p]][at] @ w for p in place], score)


def test_statistics_of_texts():
    import pyarrow as pa

    x = statistics.describe(pa.array(["Ab ab ab!\nAb ab ab!\n\nz", None, "", "%%% 12"]))
    names = list(statistics.NAMES)
    assert x.shape == (4, len(names)) and not x[1].any() and not x[2].any()
    row = dict(zip(names, x[0], strict=True))
    assert math.isclose(row["distinct_words"], 3 / 7) and math.isclose(row["distinct_lines"], 2 / 3) and math.isclose(row["top_word"], 4 / 7)
    assert math.isclose(row["same_as_before"], 3 / 7) or row["same_as_before"] > 0
    one = statistics.describe(pa.array(["Ab ab ab!\nAb ab ab!\n\nz"]))
    assert np.allclose(one[0], x[0])


def test_language_scores(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(f"{'ab'[k % 2]}{rng.randrange(60)}" for k in range(rng.randrange(1, 200)))) for i in range(120)]
    rows += [(500, None), (501, "  "), (502, "Never Seen"), (502, "Never Seen"), (None, "a1 b1")]
    got = tuples(brown.score_texts(documents(spark, rows, extra=True)), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    split = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(w for i, t in rows if not held(i, 10, 0) for w in split(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(i), held(i, 10, 0), len(split(t)), sum(counts[w] > 0 for w in split(t)), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in split(t)), 6)) for i, t in rows)
    assert sorted((str(i), h, k, m, n, round(b, 6)) for i, h, k, m, n, b, _ in got) == want
    # Words alternate between two sets; classes learn that, single words don't.
    assert sum(g[6] for g in got if g[1]) > sum(g[5] for g in got if g[1]) * 0.95
    assert all(math.isfinite(g[6]) and g[6] <= 1e-9 for g in got)


def test_language_scores_without_training_or_rows(spark):
    ids = [i for i in range(200) if held(i, 10, 0)][:3]
    got = tuples(brown.score_texts(documents(spark, [(i, t) for i, t in zip(ids, (None, "a b", "a"), strict=True)])), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    assert all(g[1] == g[2] == 0 and math.isclose(g[3], g[0] * math.log10(0.1 / 0.1)) and math.isfinite(g[4]) for g in got)
    assert brown.score_texts(documents(spark, [])).count() == 0
    assert brown.score_texts(hostile(spark)).count() == 16


def test_exchange_finds_the_classes():
    rng = np.random.Generator(np.random.PCG64(7))
    of = rng.integers(0, 3, 60)
    chain = np.zeros((3, 3)) + 0.05
    chain[[0, 1, 2], [1, 2, 0]] = 1
    table = np.round(chain[of][:, of] * 40 * rng.random((60, 60)))
    found = brown.exchange(table, 3, 20)
    assert len({(a, b) for a, b in zip(of.tolist(), found.tolist(), strict=True)}) == 3


def test_words_of_long_texts_are_counted_in_small_memory():
    """Work arrays are a multiple of the text at hand, so texts are taken in small slices; counts stay the same."""
    import tracemalloc

    import pyarrow as pa

    from odolake.llm import brown

    texts = [" ".join(f"w{(i * 7919 + k * k) % 5000}" for k in range(1500)) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    list(brown._counted(iter([batch.slice(0, 1)])))
    tracemalloc.start()
    out = list(brown._counted(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(t) for t in texts) > 7 << 20 and peak < 100 << 20
    assert sum(sum(b["c"].to_pylist()) for b in out) == 900 * 1500


def cycles(rng, docs, stock, length, order=(0, 1, 2)):
    """Texts whose words come from three stocks in turn; the words' endings tell nothing."""
    return [" ".join(rng.choice(stock[order[k % 3]]) for k in range(length)) for _ in range(docs)]


def stocks(rng, size):
    return [[f"{rng.getrandbits(60):x}" for _ in range(size)] for _ in range(3)]


def test_rare_words_are_clustered_by_what_stands_beside_them(spark):
    """More words than are frequent, each seen a few times: a held-out text in the usual order is likelier than one against it."""
    rng = random.Random(11)
    stock = stocks(rng, 1500)
    train = [i for i in range(2000) if not held(i, 10, 0)][:600]
    out = [i for i in range(2000) if held(i, 10, 0)][:40]
    usual, against = cycles(rng, 20, stock, 60), cycles(rng, 20, stock, 60, (2, 1, 0))
    rows = [*zip(train, cycles(rng, 600, stock, 45), strict=True), *zip(out[:20], usual, strict=True), *zip(out[20:], against, strict=True)]
    score = {i: s for i, h, s in tuples(brown.score_texts(documents(spark, rows)), "doc_id", "held_out", "score") if h}
    gap = np.mean([score[i] for i in out[:20]]) - np.mean([score[i] for i in out[20:]])
    assert gap / 60 > 0.5


def test_scores_are_those_of_the_classes(spark, monkeypatch):
    """The scores from plain Python, from the classes that all words got; information rises from sweep to sweep."""
    import pyarrow as pa

    rng = random.Random(12)
    stock = stocks(rng, 500)
    rows = list(enumerate(cycles(rng, 150, stock, 40)))
    rows += [(i, f"never{i} {rng.choice(stock[0])} seen{i} before{i} {rng.choice(stock[1])}") for i in range(200, 260)] + [(300, None), (None, " ".join(stock[2][:9]))]
    seen, real = {}, brown.cluster

    def cluster(chunks, parts, seeds):
        seen["chunks"], seen["parts"] = chunks, parts
        seen["state"], seen["rises"] = real(chunks, parts, seeds)
        return seen["state"], seen["rises"]

    monkeypatch.setattr(brown, "cluster", cluster)
    monkeypatch.setattr(brown, "CHUNK", 500)
    got = {i: s for i, s in tuples(brown.score_texts(documents(spark, rows)), "doc_id", "score")}
    assert len(seen["rises"]) > 1 and seen["rises"] == sorted(seen["rises"])
    parts, of = seen["parts"], {}
    replies = pa.concat_tables([s.toArrow() for s in seen["state"]])
    chunks = seen["chunks"].toArrow()
    for i in range(chunks.num_rows):
        row = chunks.slice(i, 1)
        chunk = brown.Chunk(row, parts, replies.filter(pa.compute.equal(replies["chunk"], row["chunk"][0])))
        for h, c in zip(chunk.types.tolist(), chunk.of.tolist(), strict=True):
            assert of.setdefault(h, c) == c
    end = int(brown.END)
    split = lambda t: [*brown._tokens(pa.array([t], pa.string()))[0].tolist(), end]
    train = [split(t) for i, t in rows if not held(i, 10, 0)]
    count = Counter(w for t in train for w in t)
    assert all(of[w] < brown.CLASSES for w in count)
    n2 = Counter((of[a], of[b]) for t in train for a, b in zip([end, *t[:-1]], t, strict=True))
    n1, n0, types = Counter(), Counter(), Counter(of[w] for w in count)
    for (f, g), n in n2.items():
        n0[f] += n
        n1[g] += n
    total, ones, twos = sum(count.values()), sum(n == 1 for n in count.values()), sum(n == 2 for n in count.values())
    discount, floor = min(0.95, max(0.05, ones / (ones + 2 * twos))), -math.log10(10 * (total + len(count) + 1))
    step = lambda f, g: math.log10((n2[f, g] + 16 * n1[g] / total) / (n0[f] + 16)) if n1[g] else floor
    unknown = lambda g: math.log10(discount * types[g] / n1[g]) if n1[g] else floor
    for i, t in rows:
        want, f = 0.0, of[end]
        for w in split(t):
            g = of[w] if w in count else max(range(brown.CLASSES), key=lambda g: (round(step(f, g) + unknown(g), 9), -g))
            want += step(f, g) + (math.log10(count[w] - discount) - math.log10(n1[g]) if w in count else unknown(g))
            f = g
        assert math.isclose(got[i], want, abs_tol=1e-6)


def test_a_move_is_the_one_that_raises_information_most():
    rng = np.random.Generator(np.random.PCG64(3))
    v, k = 300, 6
    # Words of class c stand before those of class c + 1 mostly; a fifth of the words are in a class by chance.
    seq = (np.cumsum(rng.choice([1, 1, 1, 2, 4], 12_000)) % k) * (v // k) + rng.integers(0, v // k, 12_000)
    of = np.where(rng.random(v) < 0.2, rng.integers(0, k, v), np.arange(v) // (v // k))

    def table(of):
        return np.bincount(of[seq[:-1]] * k + of[seq[1:]], minlength=k * k).reshape(k, k).astype(float)

    a, b = seq[:-1], seq[1:]
    own, keys = a == b, 2 * k + 1
    code, n = np.unique(np.concatenate((b[~own] * keys + of[a[~own]], a[~own] * keys + k + of[b[~own]], b[own] * keys + 2 * k)), return_counts=True)
    got = brown.better(table(of), of.astype(np.uint8), code // keys, code % keys, n)
    for w in range(v):
        other, value = of.copy(), []
        for other[w] in range(k):
            value.append(brown.information(table(other)))
        # What a word's own counts do to each other is left out, which is little beside the gain.
        assert max(value) - value[got[w]] < 0.05 * (max(value) - min(value))
