"""Packing token sequences by first-fit decreasing in randomised groups.

A document is its tokenizer's ids followed by one end id, cut every ``CAPACITY`` ids. A piece of full length is a
sequence of its own; the others, one at most for each document, are dealt at random into groups of about
``GROUP`` and packed there, longest first, each into the first bin with room. A tournament tree over the bins'
remaining capacities finds that bin in logarithmic time. Groups are independent, so they run anywhere and a lost
executor repeats its own; only the lengths are shuffled, never the ids.

Tokenizing works word by word: white space never reaches this tokenizer's model and no rule looks across it, so the ids
of a text are those of its white-space separated words in order. A slice of texts looks each distinct word up once, by a
64-bit hash, and each worker keeps the ids of words it has met, in two generations of bounded size.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed as often as they occur. A null
doc_id stays null. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import kept, short_batches, slices
from odolake.llm.kernels import flat, prefix_sums, span_hashes, word_spans

CAPACITY, END, GROUP = 2048, 1, 8192
#: Words a worker remembers in each of two generations, and the longest it remembers, in bytes.
REMEMBERED, LONGEST = 400_000, 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Words of these characters are told apart again when they are encoded together; the parts the tokenizer makes of one.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^A-Za-z0-9À-ÖØ-öø-ÿ]+")


class WordIds:
    """Ids of words as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """A part's last id, and no other, ends a word; so the ids of many words encoded as one text are told apart."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t]
        out: list[bytes | None] = [None] * len(words)
        if plain:
            encoded = self.model.encode_batch_fast([" ".join(texts[i] for i in plain)], add_special_tokens=False)[0].ids
            ids = np.array(encoded, np.uint32)
            parts = np.cumsum([1 if (t := texts[i]).isalpha() else len(_PARTS.findall(t)) for i in plain])
            edges = np.flatnonzero(self.ends[ids]) + 1
            if len(edges) != parts[-1]:
                raise ValueError("the tokenizer doesn't end words as expected")
            stops = (4 * edges[parts - 1]).tolist()
            data = ids.astype("<u4").tobytes()
            for i, a, b in zip(plain, [0, *stops[:-1]], stops, strict=True):
                out[i] = data[a:b]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.model.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return out

    def known(self, hashes: list[int], word: Callable[[int], bytes]) -> list[bytes]:
        """The ids of distinct words, told by their hashes; ``word(i)`` gives the bytes of the i-th."""
        new, old = self.new, self.old
        out = [new.get(h) for h in hashes]
        missing = []
        for i, ids in enumerate(out):
            if ids is None:
                h = hashes[i]
                if h in old:
                    out[i] = new[h] = old[h]
                else:
                    missing.append(i)
        texts = [word(i) for i in missing]
        for i, text, ids in zip(missing, texts, self._encoded(texts), strict=True):
            out[i] = ids
            if len(text) <= LONGEST:
                new[hashes[i]] = ids
        if len(new) > REMEMBERED:
            self.old, self.new = new, {}
        return out


_MODELS: dict[str, WordIds] = {}


def _ids(model: WordIds, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts one after the other, and where each text's begin (one entry more than texts)."""
    data, offsets = flat(texts)
    starts, ends, doc = word_spans(data, offsets)
    hashes = span_hashes(*prefix_sums(data, lowered=False), starts, ends)
    distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    coded = model.known(distinct.tolist(), lambda i: data[starts[first[i]] : ends[first[i]]].tobytes())
    size = np.array([len(c) // 4 for c in coded], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))[:-1]
    number = size[back]
    after = np.cumsum(number)
    place = np.arange(after[-1] if len(after) else 0) + np.repeat(begin[back] - (after - number), number)
    at = np.concatenate(([0], after))[np.searchsorted(doc, np.arange(len(texts) + 1))]
    return np.frombuffer(b"".join(coded), "<u4")[place], at


def _cut(path: str, capacity: int, end: int):
    def pieces(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path not in _MODELS:
            _MODELS[path] = WordIds(path)
        model = _MODELS[path]
        stop = struct.pack("<I", end)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids, at = _ids(model, batch.column("text"))
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    own = ids[a:b].tobytes() + stop
                    n = b - a + 1
                    for start in range(0, n, capacity):
                        part = own[4 * start : 4 * (start + capacity)]
                        for column, v in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return pieces


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and place in it for each length, in the order given; no length is above ``capacity``."""
    leaves = 1 << max(0, len(lengths) - 1).bit_length()
    room = [capacity] * (2 * leaves)  # room[i]: the most that any bin below node i can still take
    bins, places = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n, node = lengths[i], 1
        while node < leaves:
            node *= 2
            if room[node] < n:
                node += 1
        bins[i], places[i] = node - leaves, capacity - room[node]
        room[node] -= n
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins, places


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of (doc_id: long, text: string)."""
    short_batches(docs.sparkSession)
    cut = kept(docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, end), PIECES))
    groups = max(1, -(-cut.where(F.col("length") < capacity).count() // group))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        bins, places = first_fit_decreasing(frame["length"].tolist(), capacity)
        # Even numbers are bins of groups; fewer than 2^24 pieces are in one group.
        frame["sequence_id"] = ((int(frame["g"].iloc[0]) << 24) + pd.Series(bins, index=frame.index, dtype="int64")) * 2
        frame["offset"] = pd.Series(places, index=frame.index, dtype="int64")
        return frame.drop(columns="g")

    numbered = cut.withColumn("g", F.monotonically_increasing_id())
    full = numbered.where(F.col("length") == capacity).withColumn("sequence_id", F.col("g") * 2 + 1).withColumn("offset", F.lit(0).cast("long")).drop("g")
    dealt = numbered.where(F.col("length") < capacity).withColumn("g", F.pmod(F.xxhash64("g"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(packed, f"{PIECES}, sequence_id long, offset long").union(full)
