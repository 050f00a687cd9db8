"""How far the sources of a language differ in their words, by Gustavson's row-wise products.

A group is a (lang, source); terms are runs of letters, and a lang keeps those of at least ``LEAST`` of its documents. Every
group gives every kept term a smoothed share in billionths, p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two groups
differ in a term by floor((p - q)^2 / (p + q)). A pair of groups is to sum this over all V terms, of which most groups lack most.

The index is term-major: one row for each kept term with the counts of the groups that have it. It is dealt into blocks by the
hash of the term. In a block each group in turn is a row of the product: it has a dense accumulator with a cell for each peer of
its lang, which starts at the zero baseline (its terms against a peer that has none of them), and each of its terms is
scattered through its index row into the cells of the peers that have it, replacing the baseline. So no pair of postings is
ever a row; a block gives its accumulators, which are summed by pair. The measure is the same both ways, so a group scatters into
the peers after it and gives those before it the baseline only. The terms that neither has follow from the number of terms
each group has. All of it is whole numbers.

A term has one posting for each source at most, whatever its frequency, and a block holds about ``BLOCK`` postings, so neither a
common word nor a large source lands in one task. The peers of a lang travel to each of its blocks: pairs of sources are the result.

Defined cases: null text, lang and source are empty strings. A lang without kept terms has pairs with value 0 and no terms.
A group without terms is a group. Repeated rows are documents of their own. An empty table gives no rows. Other columns than
text, lang and source are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.llm.common import kept, slices

LEAST, TOP, BILLION = 10, 10, 1_000_000_000
#: Postings of a block, and entries a counting task holds before it hands them on.
BLOCK, HELD = 1 << 17, 1 << 18
#: Letters of ASCII and everything beyond it, in UTF-8.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_PARTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents by lang, source and term, handed on whenever many are held."""
    held: dict[tuple, tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = pa.array(docs.keys(), pa.binary()).cast(pa.string())
            names = [pa.repeat(pa.scalar(name, pa.string()), len(terms)) for name in (lang, source)]
            yield pa.RecordBatch.from_arrays([*names, terms, pa.array(map(n.__getitem__, docs), pa.int64()), pa.array(docs.values(), pa.int64())], schema=_COUNTS)
        held.clear()

    entries = 0
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = batch.column("text").cast(pa.binary())
            for text, lang, source in zip(texts, batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True):
                n, docs = held[lang, source]
                found = _TERM.findall(text.as_py().lower())
                known = len(docs)
                n.update(found)
                docs.update(set(found))
                entries += len(docs) - known
            if entries > HELD:
                yield from out()
                entries = 0
    yield from out()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n occurrences and docs, the documents with the term."""
    texts = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    schema = "lang string, source string, term string, n long, docs long"
    return texts.mapInArrow(_count, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_index(counts: DataFrame, least: int = LEAST) -> DataFrame:
    """The term-major index: lang, term, n over the lang, and postings, the sources that have it with their counts."""
    posting = F.collect_list(F.struct("source", "n"))
    rows = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), posting.alias("postings"))
    return rows.where(F.col("docs") >= least).drop("docs")


def group_sizes(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Every occurring group: lang, source, size (N), terms (kept ones it has), vocabulary (V) and lang_size (N of the lang)."""
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    own = index.select("lang", F.explode("postings").alias("p")).groupBy("lang", F.col("p.source").alias("source"))
    own = own.agg(F.sum("p.n").alias("size"), F.count(F.lit(1)).alias("terms"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("vocabulary"), F.sum("n").alias("lang_size"))
    return groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["size", "terms", "vocabulary", "lang_size"])


def shares(counts: np.ndarray, size: np.ndarray | int, vocabulary: int) -> np.ndarray:
    """Smoothed shares in billionths, exact for any count."""
    whole = np.broadcast_to(np.asarray(size, np.int64) + 2 * vocabulary, counts.shape)
    out = np.empty(len(counts), np.int64)
    large = counts > 9_000_000_000
    out[~large] = 1 + BILLION * (counts[~large] + 2) // whole[~large]
    out[large] = [1 + BILLION * (int(c) + 2) // int(w) for c, w in zip(counts[large], whole[large], strict=True)]
    return out


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What two shares differ by."""
    return (p - q) ** 2 // (p + q)


def _first(values: np.ndarray, terms: np.ndarray, names: pa.Array, most: int) -> list[tuple[bytes, int]]:
    """The largest values with their terms, ties by the bytes of the term."""
    if len(values) > most:
        some = values >= np.partition(values, len(values) - most)[len(values) - most]
        values, terms = values[some], terms[some]
    return sorted(((names[int(t)].as_py(), int(v)) for t, v in zip(terms, values, strict=True)), key=lambda x: (-x[1], x[0]))[:most]


def _rows_of(block: pa.Table, peers: pa.Table, top: int) -> Iterator[tuple]:
    """The accumulators of a block's groups and their foremost terms, as rows of ``_PARTS``."""
    if block.num_rows == 0:
        return
    lang = block.column("lang")[0].as_py()
    peers = peers.sort_by("source")
    lists = block.column("postings").combine_chunks()
    starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    names = block.column("term").combine_chunks().cast(pa.binary())
    peer_names = peers.column("source").to_pylist()
    ids = {name: i for i, name in enumerate(peer_names)}
    # Term-major: the postings of term t are those from starts[t] to starts[t + 1].
    dictionary = flat.field("source").dictionary_encode()
    peer = np.array([ids[name] for name in dictionary.dictionary.to_pylist()], np.int64)[dictionary.indices.to_numpy(zero_copy_only=False)]
    counts = flat.field("n").to_numpy(zero_copy_only=False)
    sizes = peers.column("size").to_numpy().astype(np.int64)
    vocabulary, lang_size = peers.column("vocabulary")[0].as_py(), peers.column("lang_size")[0].as_py()
    term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    share = shares(counts, sizes[peer], vocabulary)
    zero = shares(np.zeros(len(sizes), np.int64), sizes, vocabulary)
    whole = shares(block.column("n").to_numpy().astype(np.int64), lang_size, vocabulary)
    # Group-major: the rows of the product.
    order = np.argsort(peer, kind="stable")
    bounds = np.searchsorted(peer[order], np.arange(len(sizes) + 1))
    for i in range(len(sizes)):
        own = order[bounds[i] : bounds[i + 1]]
        if not len(own):
            continue
        p, at = share[own], term[own]
        # Terms with the same share miss a peer without them by the same amount.
        values, times = np.unique(p, return_counts=True)
        baseline = np.zeros(len(sizes), np.int64)
        for v, n in zip(values.tolist(), times.tolist(), strict=True):
            baseline += n * apart(np.int64(v), zero)
        cells = baseline.copy()
        lengths = starts[at + 1] - starts[at]
        step = np.concatenate(([0], np.cumsum(lengths)))
        first = 0
        # Scatter in stretches, so that as few postings are copied as fit a slice.
        while first < len(own):
            last = max(first + 1, int(np.searchsorted(step, step[first] + HELD, "right")) - 1)
            n = lengths[first:last]
            to = np.repeat(starts[at[first:last]] - (step[first:last] - step[first]), n) + np.arange(int(n.sum()))
            after = peer[to] > i
            to = to[after]
            mine, other, j = np.repeat(p[first:last], n)[after], share[to], peer[to]
            np.add.at(cells, j, apart(mine, other) - apart(mine, zero[j]) - apart(zero[i], other) + apart(zero[i], zero[j]))
            first = last
        name = peer_names[i]
        for j in range(i):
            yield lang, peer_names[j], "pair", name, int(baseline[j])
        for j in range(i + 1, len(peer_names)):
            yield lang, name, "pair", peer_names[j], int(cells[j])
        more = np.flatnonzero(p > whole[at])
        for item, value in _first(apart(p[more], whole[at[more]]), at[more], names, top):
            yield lang, name, "term", item.decode(), value


def _accumulate(top: int):
    def block(terms: pa.Table, peers: pa.Table) -> pa.Table:
        columns = list(zip(*_rows_of(terms, peers, top), strict=True)) or [()] * len(_PARTS)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTS, strict=True)], schema=_PARTS)

    return block


def _zero(size: str, vocabulary: str = "vocabulary") -> Column:
    """The share of a term that a group doesn't have; of no use where the lang keeps none."""
    return F.expr(f"1 + {2 * BILLION}L div greatest(1L, {size} + 2 * {vocabulary})")


def source_divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: all peers of every group (pair), and its foremost terms (term)."""
    spark = docs.sparkSession
    index = kept(term_index(term_counts(docs), least))
    groups = kept(group_sizes(docs, index))
    postings = groups.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    blocks = max(1, -(-postings // BLOCK))
    dealt = index.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
    sent = dealt.select(F.col("lang").alias("of"), F.col("block").alias("to")).distinct().join(groups.withColumnRenamed("lang", "of"), "of")
    schema = "lang string, source string, part string, item string, value long"
    parts = kept(dealt.groupBy("lang", "block").cogroup(sent.groupBy("of", "to")).applyInArrow(_accumulate(top), schema))

    half = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("found"))
    sums = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "found"))
    one = groups.select("lang", "vocabulary", "source", "terms", _zero("size").alias("z"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("terms").alias("item_terms"), _zero("size").alias("item_z"))
    pairs = one.join(other, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left")
    # Terms that neither has, less those that both have: the scattered cells count these twice.
    neither = F.expr("(vocabulary - terms - item_terms) * ((z - item_z) * (z - item_z) div (z + item_z))")
    value = F.when(F.col("vocabulary") == 0, 0).otherwise(F.coalesce("found", F.lit(0)) + neither)
    pair = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    term = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return pair.withColumn("rank", rank).unionByName(term)
