"""Fill-in-the-middle, source divergence and sharding against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from odolake.llm import divergence, middles, shards
from odolake.llm.queries import QUERIES, SQL
from tests.llm.helpers import SF, documents, hostile, words

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def ordered(found):
    return sorted((tuple(sorted(r.items())) for r in found), key=repr)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_source_divergence", "op13_sharding"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert ordered(rows(QUERIES[name](spark, SF))) == ordered([dict(zip(names, r, strict=True)) for r in want.fetchall()])


# Fill-in-the-middle


def plain_middle(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    one, two = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(tokens[:one]), "".join(tokens[one:two]), "".join(tokens[two:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_cuts_are_those_of_plain_python(spark):
    rng = random.Random(8)
    given_rows = [(r.doc_id, r.text) for r in hostile(spark).select("doc_id", "text").collect()]
    for i in range(100, 160):
        given_rows.append((i, "".join(rng.choice(["word", " ", "\t\n", "naïve", "文字🙂", "<", "<P", ">", "x" * 400]) for _ in range(rng.randrange(80)))))
    given_rows += [(i, f"a {m} b c d") for i, m in enumerate(("<P>", "<S>", "<M>"), 200)]
    given_rows.append((300, "\n".join(words(rng, 3000) for _ in range(40)) + "y" * 70000 + " z" * 50000))
    filled = middles.fill_in_middle(documents(spark, given_rows, extra=True))
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").collect()]
    assert sorted(got, key=repr) == sorted(((d, *plain_middle(d, t)) for d, t in given_rows), key=repr)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    digests = rows(middles.digests(filled))
    want = Counter(hashlib.sha256((t or "").encode()).hexdigest() for _, t in given_rows)
    assert Counter(r["restored_sha256"] for r in digests) == want
    assert middles.digests(middles.fill_in_middle(documents(spark, []))).count() == 0


def test_every_boundary_is_found_through_the_index(spark):
    rng = random.Random(3)
    text = " ".join("x" * rng.choice([1, 2, 9, 9000] if i % 500 == 0 else [1, 2, 3, 12]) for i in range(3000)) + " \n"
    index = documents(spark, [(1, text)]).withColumn("index", middles.boundary_index("text"))
    ranks = index.selectExpr("index", "explode(sequence(0L, index.n)) AS rank")
    import pyspark.sql.functions as F

    got = dict(ranks.select("rank", middles.offset_at("index", F.col("rank")).alias("at")).collect())
    ends = [0, *(m.end() for m in TOKEN.finditer(text))]
    assert [got[i] for i in range(len(ends))] == ends
    assert index.selectExpr("size(index.ranks) AS s").first().s > 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 9), st.integers(1, 100_000)), max_size=400), st.integers(1, 6))
def test_segments_keep_their_bound(steps, repeat):
    offsets = np.concatenate(([0], np.cumsum(np.array(steps * repeat, np.int64))))
    ranks, firsts, slopes, residuals = middles.fit(offsets)
    assert np.abs(residuals).max() <= middles.BOUND + 1
    for i, first in enumerate(ranks):
        until = ranks[i + 1] if i + 1 < len(ranks) else len(offsets)
        guess = middles.predict(np.arange(until - first), firsts[i], slopes[i])
        assert (guess + residuals[first:until] == offsets[first:until]).all()


def test_even_text_needs_one_segment():
    assert len(middles.fit(np.arange(0, 3_000_000, 6))[0]) == 1


# Source divergence


def plain_divergence(given_rows, least=10, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in given_rows:
        text, lang, source = text or "", lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(found)
        docs[lang].update(set(found))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        v = len(kept)

        def share(count, kept=kept, v=v):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (n + 2 * v) for t in kept}

        shares = {s: share(counts[lang, s]) for s in sources}
        whole = share(sum((counts[lang, s] for s in sources), Counter()))

        def apart(p, q):
            return (p - q) ** 2 // (p + q)

        for s in sources:
            pair = [(sum(apart(shares[s][t], shares[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(apart(shares[s][t], whole[t]), t) for t in kept if counts[lang, s][t] and shares[s][t] > whole[t]]
            for part, items, most in (("pair", pair, None), ("term", term, top)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def mixed_sources(seed):
    rng = random.Random(seed)
    made = []
    for i in range(240):
        lang = rng.choice(["en", "de", None])
        source = "hot" if i % 3 == 0 else rng.choice(["a", "b", "ü", "", None])
        stock = ["Alpha", "beta", "ÄÖ", "äö", "x1y", "文字", "don't", *(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(8))}" for _ in range(8))]
        made.append((" ".join(rng.choice(stock) for _ in range(rng.randrange(60))), lang, source))
    return made + [(None, "en", "empty"), ("", "xx", "one"), ("only few words", "xx", "two"), ("lone", "yy", "alone"), ("beta " * 5000, "en", "a")]


@pytest.mark.parametrize("block", [1 << 20, 8])
def test_divergence_is_that_of_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(divergence, "BLOCK", block)
    given_rows = mixed_sources(5)
    docs = documents(spark, [(i, text, source, lang) for i, (text, lang, source) in enumerate(given_rows)], extra=True)
    got = [(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.source_divergence(docs).collect()]
    assert len(got) == len(set(got))
    assert set(got) == plain_divergence(given_rows)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[4] == 0 for r in got)


def test_divergence_of_hostile_and_empty_tables(spark):
    docs = hostile(spark)
    given_rows = [(r.text, r.lang, r.source) for r in docs.select("text", "lang", "source").collect()]
    got = {(r.lang, r.source, r.part, r.item, r.value, r.rank) for r in divergence.source_divergence(docs, least=2).collect()}
    assert got == plain_divergence(given_rows, least=2)
    assert divergence.source_divergence(documents(spark, [])).count() == 0


def test_scatter_goes_on_over_slices(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    lists = [[{"source": s, "n": rng.randrange(1, 9)} for s in "abcde" if rng.random() < 0.5] or [{"source": "a", "n": 1}] for _ in range(50)]
    block = pa.table({"lang": ["en"] * 50, "term": [f"t{i}" for i in range(50)], "n": [sum(p["n"] for p in x) for x in lists], "postings": lists})
    size = {s: sum(p["n"] for x in lists for p in x if p["source"] == s) for s in "abcde"}
    peers = pa.table({"source": list("abcde"), "size": [size[s] for s in "abcde"], "vocabulary": [50] * 5, "lang_size": [sum(size.values())] * 5})
    whole = sorted(divergence._rows_of(block, peers, 10))
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(divergence._rows_of(block, peers, 10)) == whole


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 5, 9_000_000_000, 9_000_000_001, 10**15], np.int64)
    got = divergence.shares(counts, 2 * 10**15, 1000)
    assert got.tolist() == [1 + 10**9 * (int(c) + 2) // (2 * 10**15 + 2000) for c in counts]


# Sharding


def plain_shard(doc_id, n):
    key = "" if doc_id is None else str(doc_id)
    return max(range(n), key=lambda i: (int(hashlib.md5(f"{key}:{i}".encode()).hexdigest()[:13], 16), -i))


def test_shards_are_those_of_plain_python(spark):
    docs = hostile(spark).unionByName(documents(spark, [(i, f"text {i}") for i in range(1000, 1600)], extra=True))
    given_rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = shards.shard_documents(docs).collect()
    want = Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "key", plain_shard(d, 40), plain_shard(d, 41)) for d, t in given_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got) == want
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert all(r.grown_shard in (r.shard, 40) for r in got) and any(r.grown_shard == 40 for r in got)
    assert shards.shard_documents(documents(spark, [])).count() == 0


def test_a_record_that_repeats_often_gets_a_slot_each_time(spark, monkeypatch):
    monkeypatch.setattr(shards, "RUN", 7)
    docs = documents(spark, [(1, "same")] * 100 + [(i, "other") for i in range(50)])
    got = shards.shard_documents(docs, 3).collect()
    assert len(got) == 150
    for shard in range(3):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_weights_set_the_shares_and_little_moves(spark):
    import pyspark.sql.functions as F

    keys = spark.range(20000).withColumnRenamed("id", "key")
    weights = [1.0, 2.0, 5.0]
    one = shards.dealt(keys, "key", weights, grown=2.0)
    share = {r["shard"]: r["count"] / 20000 for r in one.groupBy("shard").count().collect()}
    assert all(abs(share[i] - w / 8) < 0.02 for i, w in enumerate(weights))
    moved = one.where("shard <> grown_shard").agg(F.count("*"), F.min("grown_shard"), F.max("grown_shard")).first()
    assert moved[1:] == (3, 3) and abs(moved[0] / 20000 - 0.2) < 0.02
    # A shard that loses weight only gives away.
    less = shards.dealt(keys, "key", [1.0, 2.0, 4.0]).select("key", F.col("shard").alias("now"))
    assert one.join(less, "key").where("shard <> now AND shard <> 2").count() == 0


def test_written_shards_hold_all_records(spark, tmp_path):
    docs = documents(spark, [(i, f"text {i}") for i in range(300)] + [(7, "again")] * 40)
    summary = shards.write_shards(docs, "doc_id", [1.0] * 5, str(tmp_path / "out"), files=2)
    assert summary.agg({"rows": "sum"}).first()[0] == 340 and summary.agg({"files": "max"}).first()[0] <= 2
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.doc_id for r in back.collect()) == sorted([*range(300), *[7] * 40])
    assert all(r.shard == max(range(5), key=lambda i: int(hashlib.md5(f"{r.doc_id}:{i}".encode()).hexdigest()[:13], 16)) for r in back.collect())
