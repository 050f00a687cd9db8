"""Near-duplicates of documents, lines and vectors against brute force."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from odolake.llm import components as components_module
from odolake.llm import embeddings, lines, links, minhash, sketch
from odolake.llm.common import kept
from odolake.llm.components import components
from odolake.llm.kernels import flat, prefix_sums
from tests.llm.helpers import SF, documents, hostile, tuples, words


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), r) for i, r in roots_of(sets, links).items()}


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (160, 7)]
    links += [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(120)]
    rng.shuffle(links)
    want = roots_of({x for link in links for x in link}, links)
    frame = spark.createDataFrame([*links, (None, 3), (9, None)], "a long, b long")
    got = dict(tuples(components(frame), "node", "root"))
    assert got == {n: r for n, r in want.items() if n != 5}


@pytest.mark.parametrize(("block", "most"), [(200_000, 2), (100, 99)])
def test_few_links_need_no_rounds(spark, monkeypatch, block, most):
    """What fits a block is written twice, contracted by partitions and as one; what doesn't goes through rounds, with the same roots."""
    written = []
    monkeypatch.setattr(components_module, "BLOCK", block)
    monkeypatch.setattr(components_module, "kept", lambda df: written.append(1) or kept(df))
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(1000, 1180)] + [(rng.randrange(500), rng.randrange(500)) for _ in range(300)]
    links += links[:40] + [(b, a) for a, b in links[:40]]
    rng.shuffle(links)
    frame = spark.createDataFrame(links, "a long, b long").repartition(7)
    want = roots_of({x for a, b in links if a != b for x in (a, b)}, links)
    assert dict(tuples(components(frame), "node", "root")) == want
    assert len(written) <= most and (block > 1000 or len(written) > 2)


def test_sketch_agrees_with_similarity():
    rng = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 9, 60, 700):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        s = sketch.fast_sketch(a)
        assert (s == sketch.fast_sketch(rng.permutation(a))).all()
    common, x, y = (rng.integers(0, 1 << 63, k, dtype=np.uint64) for k in (600, 100, 100))
    agree = np.mean([np.mean(sketch.fast_sketch(np.concatenate((common + np.uint64(i), x))) == sketch.fast_sketch(np.concatenate((common + np.uint64(i), y)))) for i in range(30)])
    assert abs(agree - 0.75) < 0.04


def test_documents_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(2)
    base = words(rng, 120).split()
    for i in range(60):  # a large group of near copies, some of them only linked through others
        own = list(base)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(len(own))] = f"new{rng.random()}"
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, "a b") for i in range(5)] + [(3000, "A B c d e"), (3001, "a b C d E"), (3002, "a b c d e f")]
    got = {i: (n, c) for i, n, c in tuples(minhash.near_duplicates(documents(spark, rows)), "doc_id", "n_shingles", "component_id")}
    assert got == brute(rows)


@pytest.mark.parametrize("block", [768, 3])
def test_bucket_of_several_components_is_compared_in_full(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    sets = {n: set(range(n * 100, n * 100 + 20)) for n in range(12)}
    sets[20], sets[21] = set(range(1100, 1116)), set(range(300, 319))  # linked with 11 and 3 only
    keyed = spark.createDataFrame([(n, [1, 1000 + n]) for n in sets], "node long, keys array<long>")
    items = spark.createDataFrame([(n, sorted(s), len(s)) for n, s in sets.items()], "node long, items array<long>, n long")
    got = dict(tuples(links.near_components(keyed, lambda nodes: items.join(nodes, "node"), 75), "node", "root"))
    assert got == {20: 11, 11: 11, 21: 3, 3: 3}


def test_documents_hostile_and_empty(spark):
    got = sorted(tuples(minhash.near_duplicates(hostile(spark)), "doc_id", "n_shingles", "component_id", "kept"), key=str)
    by = {g[0]: g for g in got}
    assert len(got) == 16
    assert by[1] == (1, 0, 1, True) and by[2][1] == 0 and by[3][1] == 0 and by[4] == (4, 1, 4, True)
    assert by[6][2:] == (5, False) and by[8][2:] == (8, True)
    assert [g[2:] for g in got if g[0] is None] == [(None, True)] * 2
    assert minhash.near_duplicates(documents(spark, [])).count() == 0


def test_rows_of_one_document_are_linked(spark):
    a, b = words(random.Random(1), 50), words(random.Random(2), 50)
    rows = [(1, a), (2, a), (2, b), (3, b), (4, "alone")]
    got = set(tuples(minhash.near_duplicates(documents(spark, rows)), "doc_id", "component_id"))
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4)}


def line_items(line, k):
    return {line[i : i + k] for i in range(len(line) - k + 1)} if len(line) >= k else {line}


def lines_linked(a, b):
    """Both of 39 characters and more by 5-character shingles, or both of 48 and less by 3-character ones."""
    sizes = [k for k, fits in ((5, min(len(a), len(b)) >= 39), (3, max(len(a), len(b)) <= 48)) if fits]
    return any(100 * len(line_items(a, k) & line_items(b, k)) >= 75 * len(line_items(a, k) | line_items(b, k)) for k in sizes)


def brute_lines(rows):
    """Texts after every line went that isn't the first of its component."""
    at = [(i, n, line) for i, t in rows if t for n, line in enumerate(t.split("\n")) if line.strip(" \t\r\x0b\x0c")]
    kinds = list(dict.fromkeys(x[2] for x in at))
    links = [(a, b) for a, b in itertools.combinations(range(len(kinds)), 2) if lines_linked(kinds[a], kinds[b])]
    root = {kinds[i]: r for i, r in roots_of(range(len(kinds)), links).items()}
    first: dict = {}
    for i, n, line in sorted(at):
        first.setdefault(root[line], (i, n))
    gone = {(i, n) for i, n, line in at if first[root[line]] != (i, n)}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_lines_against_brute_force(spark):
    rng = random.Random(5)
    stock = [words(rng, 30) for _ in range(12)]
    rows = []
    for i in range(40):
        out = []
        for _ in range(rng.randrange(1, 6)):
            line = rng.choice(stock) if rng.random() < 0.6 else words(rng, 25)
            if rng.random() < 0.4:
                line = line.replace(" w1", " v1", 2)
            out.append(line)
        rows.append((i, "\n".join(out)))
    rows += [(50, "All rights reserved.\n\nAll rights reserved."), (51, "ab\nab\nabc"), (52, None), (53, ""), (54, "é" * 30 + "\n" + "é" * 30)]
    got = dict(tuples(lines.dedup_lines(documents(spark, rows)), "doc_id", "text"))
    assert got == brute_lines(rows)


def test_single_edits_of_short_lines_are_linked(spark):
    """Lines of 23 to 90 characters, and copies with one character in the middle replaced, or one more, or one less."""
    rng, rows = random.Random(12), []
    for n in range(23, 91):
        line = "".join(rng.sample("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 ,.:;-()", min(n, 70)))
        line = "x" + (line + line[::-1])[: n - 2] + "y"
        at = n // 2
        rows += [(10 * n + i, t) for i, t in enumerate((line, line[:at] + "#" + line[at + 1 :], line[:at] + "#" + line[at:], line[:at] + line[at + 1 :]))]
    rows += [(i, t) for i, t in enumerate(("Copyright 2019 by the editors.", "Copyright 2021 by the editors.", "Page 17 of the yearly report", "Page 18 of the yearly report"))]
    got = dict(tuples(lines.dedup_lines(documents(spark, rows)), "doc_id", "text"))
    assert got == brute_lines(rows)
    assert [i for i, t in got.items() if t == "" and i % 10 == 0] == [] and [got[3], got[2]] == ["", rows[-2][1]]
    # Of each four, only the first stays.
    assert [i for i, t in got.items() if i >= 230 and i % 10 and t] == []


def test_line_pairs_at_the_limit_share_a_band():
    """20,000 pairs at 0.75 exactly: eight bands of four would miss about 1,000 of them."""
    rng = np.random.Generator(np.random.PCG64(9))
    pairs, common, own = 20_000, 60, 10
    left = rng.integers(0, 1 << 63, (pairs, common + own), dtype=np.uint64)
    right = left.copy()
    right[:, common:] = rng.integers(0, 1 << 63, (pairs, own), dtype=np.uint64)
    at = np.arange(pairs + 1) * (common + own)
    keys = [lines._signatures(side.ravel(), at) for side in (left, right)]
    assert np.count_nonzero(~(keys[0] == keys[1]).any(1)) <= 2


@pytest.mark.parametrize(("common", "left_only", "right_only"), [(60, 10, 10), (3, 0, 1), (300, 100, 0)])
def test_line_pairs_at_the_limit_are_alike_by_their_marks(common, left_only, right_only):
    """Pairs at 0.75 exactly are never ruled out by their marks, unrelated ones always."""
    rng = np.random.Generator(np.random.PCG64(10))
    pairs = 4000
    both, a, b = (rng.integers(0, 1 << 63, (pairs, n), dtype=np.uint64) for n in (common, left_only, right_only))
    marks = [lines._marks(lines._sketches(np.hstack((both, own)).ravel(), np.arange(pairs + 1) * (common + own.shape[1]))) for own in (a, b)]
    assert lines.alike(*marks).all()
    assert not lines.alike(marks[0][:-1], marks[1][1:]).any()
    assert lines._marks(np.zeros((0, lines.COORDINATES), np.uint64)).shape == (0, 5)


@pytest.mark.parametrize("block", [768, 3])
def test_nodes_ruled_out_by_their_marks_are_not_fetched(spark, monkeypatch, block):
    monkeypatch.setattr(links, "BLOCK", block)
    sets = {n: set(range(n * 100, n * 100 + 20)) for n in range(30)}
    sets[40], sets[41], sets[42] = set(range(1100, 1116)), set(range(300, 319)), set(range(0, 18))  # linked with 11, 3 and the hub
    mark = {40: 11, 41: 3, 42: 0, 17: 16}  # 17 and 16 only look alike
    keyed = spark.createDataFrame([(n, [1, 1000 + n], [mark.get(n, n), 7]) for n in sets for _ in range(1 + n % 2)], "node long, keys array<long>, mark array<long>")
    items = spark.createDataFrame([(n, sorted(s), len(s)) for n, s in sets.items()], "node long, items array<long>, n long")
    asked = []

    def fetch(nodes):
        asked.extend(r["node"] for r in nodes.collect())
        return items.join(nodes, "node")

    got = dict(tuples(links.near_components(keyed, fetch, 75, alike=lambda a, b: (a == b).all(axis=1)), "node", "root"))
    assert got == {40: 11, 11: 11, 41: 3, 3: 3, 42: 0, 0: 0}
    assert sorted(asked) == [0, 3, 11, 16, 17, 40, 41, 42]


def test_hubs_with_more_nodes_than_a_task_holds_are_compared(spark, monkeypatch):
    """No meeting among the first rows a task reads is complete."""
    monkeypatch.setattr(links, "HELD", 2)
    sets = {n: set(range(n * 100, n * 100 + 20)) for n in range(9)} | {20: set(range(300, 319))}
    keyed = spark.createDataFrame([(n, [1], [3 if n == 20 else n, 7]) for n in sets], "node long, keys array<long>, mark array<long>")
    items = spark.createDataFrame([(n, sorted(s), len(s)) for n, s in sets.items()], "node long, items array<long>, n long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = dict(tuples(links.near_components(keyed, lambda nodes: items.join(nodes, "node"), 75, alike=lambda a, b: (a == b).all(axis=1)), "node", "root"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == {20: 3, 3: 3}


def words_of(sketch, node):
    packs = lines._packed(lines._band_keys(sketch, 1), lines._checks(sketch), node, 1)
    return np.stack([np.frombuffer(w, np.uint64) for _, w, _ in packs], axis=1)


@pytest.mark.parametrize(("common", "left_only", "right_only"), [(60, 10, 10), (3, 0, 1), (300, 100, 0)])
def test_line_pairs_at_the_limit_are_close_in_a_band(common, left_only, right_only):
    """Of 10,000 pairs at 0.75 exactly, hardly one shares no band whose checks let it through; unrelated lines seldom pass them."""
    rng = np.random.Generator(np.random.PCG64(11))
    pairs = 10_000
    both, a, b = (rng.integers(0, 1 << 63, (pairs, n), dtype=np.uint64) for n in (common, left_only, right_only))
    left, right = (words_of(lines._sketches(np.hstack((both, own)).ravel(), np.arange(pairs + 1) * (common + own.shape[1])), own[:, 0] if own.size else both[:, 0]) for own in (a, b))
    key = lines.U64(64 - lines.KEY)
    same = (left >> key) == (right >> key)
    assert np.count_nonzero(~(same & lines.close(left, right)).any(1)) <= 1
    assert np.count_nonzero(same & (left == right)) < 0.01 * np.count_nonzero(same)
    assert lines.close(left[:-1], right[1:]).mean() < 0.02


@pytest.mark.parametrize("ranges", [1, 7])
def test_packs_hold_every_line_of_every_band_once(ranges):
    rng = np.random.Generator(np.random.PCG64(12))
    sketch, node = rng.integers(0, 1 << 63, (3000, lines.COORDINATES), dtype=np.uint64), rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    whole, found = words_of(sketch, node), np.zeros((3000, lines.BANDS), np.int64)
    for slot, words, gaps in lines._packed(lines._band_keys(sketch, 1), lines._checks(sketch), node, ranges):
        at = lines._numbers(gaps)
        found[at, slot // ranges] += 1
        assert (np.frombuffer(words, np.uint64) == whole[at, slot // ranges]).all()
    assert (found == 1).all()
    for at in ([0], [254, 255, 256, 511, 1021, 1276], [70_000]):
        assert lines._numbers(lines._gaps(np.array(at))).tolist() == at
    assert lines._numbers(b"").tolist() == []


def test_buckets_list_lines_that_are_close_and_no_copies():
    def listed(*words):
        batch = pa.RecordBatch.from_arrays([pa.array([4] * len(words), pa.int32()), pa.array([100 * i for i in range(len(words))]), pa.array([np.array([w], np.uint64).tobytes() for w in words]), pa.array([lines._gaps(np.array([1]))] * len(words))], ["slot", "chunk", "words", "gaps"])
        return sorted(x for found in lines._listed([batch]) for x in zip(found["bucket"].to_pylist(), found["ref"].to_pylist(), strict=True))

    key, far = 5 << 40, (1 << 17) - 1 << 8
    bucket = 4 << lines.KEY | 5
    assert listed(key, key, key) == []
    assert listed(key, key | far) == [] and listed(key, 6 << 40) == []
    assert listed(key | 1, key, key, key | far) == [(bucket, 1), (bucket, 101)]
    assert listed(key | far, key | 256, key | 512) == [(bucket, 101), (bucket, 201)]
    crowd = [key | far * (i % 2) | i // 2 % 256 | i // 512 << 30 for i in range(lines.CROWD + 1)]
    assert len(listed(*crowd)) == lines.CROWD + 1


def test_buckets_are_listed_as_stars_round_their_least_line():
    """Copies are told by their least number whatever the order of the chunks, so a line has the same hubs in all its bands."""
    word, other = np.array([5 << 40 | 1, 5 << 40, 6 << 40], np.uint64), np.array([5 << 40, 6 << 40 | 1], np.uint64)
    chunks = {900: (word, [0, 3, 4]), 100: (other, [2, 7])}
    for order in ([900, 100], [100, 900]):
        packs = [(4, chunk, chunks[chunk][0].tobytes(), lines._gaps(np.array(chunks[chunk][1]))) for chunk in order]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*packs, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["slot", "chunk", "words", "gaps"])
        stars = {x for found in lines._listed([batch]) for x in zip(found["ref"].to_pylist(), found["hub"].to_pylist(), strict=True)}
        assert stars == {(102, 102), (900, 102), (107, 107), (904, 107)}


def test_shingles_of_wide_short_and_repeating_lines():
    """Each line's set has as many hashes as it has shingles, the same ones wherever the line stands; a sketch does not tell their order."""
    found = ["a" * 60, "\u00e9t\u00e9 " * 15, "x", "\u4e2d\u6587", "ab", "plain words of one line, once more words of one line", "\u4e2d\u6587" * 25]
    for size in lines.SHINGLES:
        sets = lines.line_sets(pa.array([f"{size}{t}" for t in found]))
        assert [len(s) for s in sets] == [len({t[i : i + size] for i in range(max(len(t) - size + 1, 1))}) for t in found]
        assert all((np.diff(s.astype(object)) > 0).all() for s in sets)
        again = lines.line_sets(pa.array([f"{size}{t}" for t in reversed(found)]))
        assert all((x == y).all() for x, y in zip(sets, reversed(again), strict=True))
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        assert (lines._sketches(np.concatenate(sets), at) == lines._sketches(np.concatenate([s[::-1] for s in sets]), at)).all()


def test_lines_in_many_ranges_and_chunks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARE", 9)
    monkeypatch.setattr(lines, "CHUNK", 16)
    rng = random.Random(6)
    stock = [words(rng, 14) for _ in range(30)]
    rows = [(i, "\n".join(line.replace(" w1", " v1", 1) if rng.random() < 0.3 else line for line in rng.choices(stock, k=4) + [words(rng, 14)])) for i in range(60)]
    got = dict(tuples(lines.dedup_lines(documents(spark, rows).repartition(3)), "doc_id", "text"))
    assert got == brute_lines(rows)


def test_unrelated_lines_share_few_buckets():
    """Pairs that share a band, for each line, stay few while the lines grow fourfold."""
    texts = [t for r in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist() if r for t in r.split("\n")]
    found = list(dict.fromkeys(t for t in texts if t.strip()))
    random.Random(1).shuffle(found)
    meets = []
    for count in (2000, 8000):
        pairs = 0
        for long, size in enumerate(lines.SHINGLES):
            data, offsets = flat(pa.array([t for t in found[:count] if lines.classes(np.array(len(t)))[long]]))
            keys = lines._signatures(*lines._shingles(lines._heads(data), data, *prefix_sums(data, lowered=False), offsets[:-1], offsets[1:], size))
            for band in range(lines.BANDS):
                n = np.unique(keys[:, band], return_counts=True)[1]
                pairs += int((n * (n - 1) // 2).sum())
        meets.append(pairs / count)
    assert meets[1] < 8 and meets[1] < 5 * meets[0] + 1


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    rows = [(1, "alpha beta gamma delta\na line that only this row has"), (1, "alpha beta gamma delta\na line that others share too"), (0, "something else\na line that others share too")]
    got = Counter(tuples(lines.dedup_lines(documents(spark, rows)), "doc_id", "text"))
    held = Counter(line for _, t in got for line in t.split("\n") if line)
    assert held == Counter(["something else", "a line that others share too", "alpha beta gamma delta", "a line that only this row has"])


def test_lines_hostile_and_empty(spark):
    docs = hostile(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == 16
    got = tuples(out, "doc_id", "text", "score")
    texts = [t for i, t, _ in got if i == 8]
    assert texts == ["same line here for all\nand another one of them"] * 2
    assert [t for i, t, _ in got if i == 9] == ["À la carte — naïve 文字 🙂"] and [t for i, t, _ in got if i == 10] == ["\n\n\n"]
    assert [t for i, t, _ in got if i == 6] == [""] and ("no id at all" in [t for i, t, _ in got if i is None])
    assert lines.dedup_lines(documents(spark, [])).count() == 0


def brute_vectors(rows):
    usable = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            usable[i] = (np.array(v, float) / np.linalg.norm(np.array(v, float)), label)
    links = [(a, b) for a, b in itertools.combinations(usable, 2) if usable[a][1] == usable[b][1] and len(usable[a][0]) == len(usable[b][0]) and usable[a][0] @ usable[b][0] >= 0.93]
    root = roots_of([r[0] for r in rows], links)
    return {i: (sum(i in link for link in links), root[i]) for i, _, _ in rows}


@pytest.mark.parametrize("block", [512, 7])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").limit(150).collect()]
    rows += [(90_000 + r[0], r[1], r[2]) for r in rows[:6]]  # exact copies
    centre = rng.standard_normal(64)
    rows += [(10_000 + i, (centre + 0.15 * rng.standard_normal(64)).tolist(), 3) for i in range(40)]
    rows += [(20_000, None, 1), (20_001, [], 1), (20_002, [0.0] * 64, 1), (20_003, [1.0] * 63 + [None], 1), (20_004, [float("nan")] * 64, 1), (20_005, [1.0] * 64, None), (20_006, [1.0, 2.0], 3), (20_007, [2.0, 4.0], 3), (20_008, [float("inf")] * 64, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    got = {i: (n, c) for i, n, c in tuples(embeddings.near_embeddings(frame), "vec_id", "n_links", "component_id")}
    assert got == brute_vectors(rows)


def test_vectors_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    got = sorted(tuples(embeddings.near_embeddings(spark.createDataFrame(rows, schema)), "vec_id", "n_links", "component_id", "kept"), key=str)
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
    assert embeddings.near_embeddings(spark.createDataFrame([], schema)).count() == 0
