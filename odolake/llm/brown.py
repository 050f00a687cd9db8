"""Brown class-based bigram scores.

Words are white-space separated runs, A-Z lower-cased; each text ends with an end token. Counts of all words of all
training texts are gathered exactly. Exchange clustering assigns every word of the training texts, and the end, to one of ``CLASSES``
classes. The ``FREQUENT`` most frequent words and the end begin, by themselves: from classes of equal frequency they move one at a
time to the class that raises the mutual information of neighbouring classes most, until no move helps or ``SWEEPS`` sweeps are
done. Then all words take part, those of the start again too: how often each has words of each class before and after it is counted over all training
texts, and it goes to the class where these counts raise the mutual information most. The words are in two halves by their hash; a half moves
at once, against the matrix of class bigrams that the other half's moves have left. In the first sweep, words without a class get
one; a word that has no neighbour with a class then is dealt one by its hash and moves on from there. Sweeps go on until one raises the information by less than
``GAIN`` of it, or ``SWEEPS`` are done; one that lowers it is taken back. A word's gain is of its own move alone, and leaves out what its own counts do to each
other where it stands next to its own class. A word that is known, of class g after class f, has probability

    (n(f, g) + A n(g)/N) / (n(f) + A)  *  (c(w) - D) / n(g)

and an unknown one the second factor D V(g) / n(g), where V(g) counts the known words of class g: absolute discounting, with D = s1 / (s1 + 2
s2) from the numbers of words seen once and twice. So the known words and one unknown word of each class sum to one; an unknown word is
taken for the class that makes it likeliest after the class before it. A text begins after an end.

The texts are cut into chunks of about ``CHUNK`` words, kept as numbers into the chunk's list of words. The words are dealt by hash into parts. In each half sweep a chunk
sends every part what its words have beside them, by class, and the part answers with classes; so no table of word pairs is made, a frequent word is
at most 129 counts of a chunk, and no task holds all words. A word is told by 64 bits.

Defined cases: a null or empty text is the end alone. A null doc_id is learnt from and isn't held out. Repeated rows count as
often as they occur, and each is scored. Without training texts no word is known, N is 0 and both scores are those of
equal parts: the base's by its formula, the model's 0 for an end. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.llm.common import holds_out, kept, short_batches, slices
from odolake.llm.kernels import SALTS, U64, flat, prefix_sums, signed, span_hashes, word_spans

MODULUS, REMAINDER = 10, 0
FREQUENT, CLASSES, SWEEPS = 1024, 64, 12
STRENGTH = 16.0
#: A sweep of all words that raises the mutual information by less than this part of it is the last.
GAIN = 0.01
#: Bytes of text a task works on at once: its arrays take about 100 times that.
_SLICE = 1 << 20
#: Word counts a task merges at once, and hands on.
HELD, PART = 750_000, 500_000
#: Words of a chunk, and of all texts for each part of the words.
CHUNK, SHARE = 1_000_000, 2_500_000
#: Stands for the end among the words.
END = SALTS[4000]
#: What a word has beside it: classes before it, classes after it, itself.
KEYS = 2 * CLASSES + 1
#: Counts up to which gains are looked up, and words whose gains are worked out at once.
SMALL, BLOCK = 16, 8192

CHUNKS = "chunk long, n long, texts long, ids array<long>, held array<boolean>, sizes array<int>, words binary, types binary"
CONTEXTS = "part int, chunk long, words binary, classes binary, sizes binary, keys binary, counts binary"
REPLY = "chunk long, part int, turn int, reply binary"
#: Turns of the replies: counts, and classes of either half. Bit that goes with the class of a word from a training text.
COUNTED, HALVES, TRAINED = 2, 2, 128


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word, ends left out."""
    data, offsets = flat(texts)
    starts, ends, doc = word_spans(data, offsets)
    sums, down = prefix_sums(data)
    return span_hashes(sums, down, starts, ends), doc


def _counted(batches):
    """word, count of all texts of a partition, in parts of bounded size."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []

    def merged():
        h, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        word, back = np.unique(h, return_inverse=True)
        return word, np.bincount(back, n).astype(np.int64)

    def rows(w, n):
        return pa.RecordBatch.from_arrays([pa.array(signed(w)), pa.array(n)], ["w", "c"])

    for whole in batches:
        for batch in slices(whole, "text", _SLICE):
            parts.append(np.unique(_tokens(batch.column("text"))[0], return_counts=True))
            if sum(len(p[0]) for p in parts) > HELD:
                parts = [merged()]
                if len(parts[0][0]) > PART:
                    yield rows(*parts.pop())
    if parts:
        yield rows(*merged())


def _chunked(batches):
    """The texts of a partition in chunks: documents, their numbers of words with the ends, and words as places in the ascending list of those of the chunk."""
    task, number = TaskContext.get().partitionId(), 0
    held: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []

    def row():
        h, n, ids, out = zip(*held, strict=True)
        types, words = np.unique(np.concatenate(h), return_inverse=True)
        sizes, out = np.concatenate(n), np.concatenate(out)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), c) for c in (pa.concat_arrays(ids), pa.array(out), pa.array(sizes, pa.int32()))]
        columns = [pa.array([x], pa.int64()) for x in ((task << 32) + number, len(words), int(np.count_nonzero(~out)))]
        return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([_packed(words.astype(np.int32))], pa.binary()), pa.array([types.tobytes()], pa.binary())], [c.split()[0] for c in CHUNKS.split(", ")])

    for whole in batches:
        for batch in slices(whole, "text", _SLICE):
            h, doc = _tokens(batch.column("text"))
            n = np.bincount(doc, minlength=batch.num_rows)
            held.append((np.insert(h, np.cumsum(n), END), n + 1, batch.column("doc_id"), batch.column("held_out").to_numpy(zero_copy_only=False)))
            if sum(len(x[0]) for x in held) >= CHUNK:
                yield row()
                number, held = number + 1, []
    if held:
        yield row()


def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind: type) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    return np.frombuffer(pa.decompress(blob[8:], n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def _edges(parts: int) -> np.ndarray:
    """The least word of each part."""
    return np.array([-(-(p << 32) // parts) << 32 for p in range(parts)], np.uint64)


class Chunk:
    """A chunk's words, with their counts and classes as far as there are replies; a word without class has ``CLASSES``."""

    def __init__(self, row: pa.Table, parts: int, replies: pa.Table | None = None, seeds: tuple[np.ndarray, np.ndarray] | None = None):
        self.number, self.ids = row["chunk"][0].as_py(), row["ids"].combine_chunks().flatten()
        self.held = row["held"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.sizes = row["sizes"].combine_chunks().flatten().to_numpy()
        self.words = _unpacked(row["words"][0].as_py(), np.int32)
        self.types = np.frombuffer(row["types"][0].as_py(), np.uint64)
        self.end = int(np.searchsorted(self.types, END))
        self.half = (self.types & U64(1)).astype(np.int64)
        self.edges = np.append(np.searchsorted(self.types, _edges(parts)), len(self.types))
        self.of = np.full(len(self.types), CLASSES, np.uint8)
        self.count, self.first = np.zeros(len(self.types), np.int64), np.zeros(len(self.types), bool)
        if seeds is not None:
            words, classes = seeds
            at = np.minimum(np.searchsorted(words, self.types), len(words) - 1)
            self.of = np.where(words[at] == self.types, classes[at], CLASSES).astype(np.uint8)
        for part, turn, reply in zip(*(replies[c].to_pylist() for c in ("part", "turn", "reply")), strict=True) if replies is not None else ():
            a, b = self.edges[part : part + 2]
            if turn == COUNTED:
                both = _unpacked(reply, np.int64)
                self.count[a:b], self.first[a:b] = both >> 1, both & 1
            else:
                self.of[a:b][self.half[a:b] == turn] = _unpacked(reply, np.uint8)

    def train(self) -> tuple[np.ndarray, np.ndarray]:
        """Every word of the training texts and the word before it."""
        now = self.words[np.repeat(~self.held, self.sizes)]
        return np.concatenate((np.full(min(len(now), 1), self.end, np.int32), now[:-1])), now

    def counts(self) -> pa.Table:
        n = np.bincount(self.train()[1], minlength=len(self.types))
        return self._sent(np.arange(len(self.types)), words=self.types, counts=n.astype(np.uint32))

    def contexts(self, half: int) -> pa.Table:
        """To each part: words of this half, their classes, how many keys each has, and the keys with their counts."""
        before, now = self.train()
        some = self.half == half
        own, of = before == now, self.of.astype(np.int64)
        left, right = np.flatnonzero(some[now] & ~own & (of[before] < CLASSES)), np.flatnonzero(some[before] & ~own & (of[now] < CLASSES))
        same = np.flatnonzero(own & some[now])
        codes = (now[left] * np.int64(KEYS) + of[before[left]], before[right] * np.int64(KEYS) + CLASSES + of[now[right]], now[same] * np.int64(KEYS) + 2 * CLASSES)
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        members = np.flatnonzero(some)
        trained = np.zeros(len(self.types), np.uint8)
        trained[now] = TRAINED
        sizes = np.bincount(code // KEYS, minlength=len(self.types))[members]
        return self._sent(members, entries=sizes, words=self.types[members], classes=(self.of | trained)[members], sizes=sizes.astype(np.uint8), keys=(code % KEYS).astype(np.uint8), counts=n.astype(np.uint32))

    def _sent(self, members: np.ndarray, entries: np.ndarray | None = None, **columns: np.ndarray) -> pa.Table:
        edges = np.searchsorted(members, self.edges).tolist()
        inner = edges if entries is None else np.concatenate(([0], np.cumsum(entries)))[edges].tolist()
        parts = range(len(edges) - 1)
        out = {"part": pa.array(parts, pa.int32()), "chunk": pa.array([self.number] * len(parts), pa.int64())}
        for name, values in columns.items():
            at = inner if name in ("keys", "counts") else edges
            out[name] = pa.array([values[at[p] : at[p + 1]].tobytes() if name == "words" else _packed(values[at[p] : at[p + 1]]) for p in parts], pa.binary())
        return pa.table(out)

    def bigrams(self, items: np.ndarray | None = None) -> pa.Table:
        """Class bigrams of the training texts, and after them how many counted words each class has; or bigrams of ``items``, by their places."""
        before, now = self.train()
        if items is not None:
            at = np.minimum(np.searchsorted(items, self.types), len(items) - 1)
            of, size = np.where(items[at] == self.types, at, len(items)), len(items)
        else:
            of, size = self.of.astype(np.int64), CLASSES
        a, b = of[before], of[now]
        both = (a < size) & (b < size)
        key, n = np.unique(a[both] * size + b[both], return_counts=True)
        if items is None:
            types = np.bincount(of[self.first & (self.count > 0)], minlength=CLASSES + 1)[:CLASSES]
            key, n = np.concatenate((key, size * size + np.arange(CLASSES))), np.concatenate((n, types))
        return pa.table({"k": pa.array(key, pa.int64()), "n": pa.array(n, pa.int64())})

    def scores(self, transition: np.ndarray, size: np.ndarray, unknown: np.ndarray, discount: float, below: float, trained: bool) -> pa.Table:
        doc, docs = np.repeat(np.arange(len(self.sizes)), self.sizes), len(self.sizes)
        known = self.count > 0
        base = np.log10(self.count + 0.1) - below
        if trained:
            of = np.where(known, self.of, 0).astype(np.int64)[self.words]
            _guess(of, known[self.words], (transition + unknown[None, :]).argmax(1))
            after = np.concatenate((of[-1:], of[:-1]))  # the last word of a chunk is an end, and so is that before the first
            emit = np.where(known, np.log10(np.maximum(self.count - discount, 1e-9)), 0.0)[self.words]
            score = transition[after, of] + np.where(known[self.words], emit - size[of], unknown[of])
        else:
            score = np.where(self.words == self.end, 0.0, unknown[0])
        columns = {
            "doc_id": self.ids, "held_out": pa.array(self.held), "n_tokens": pa.array(self.sizes.astype(np.int64)),
            "n_known": pa.array(np.bincount(doc, known[self.words], docs).astype(np.int64)),
            "base_score": pa.array(np.bincount(doc, base[self.words], docs)), "score": pa.array(np.bincount(doc, score, docs)),
        }
        return pa.table(columns)


def _guess(of: np.ndarray, known: np.ndarray, likeliest: np.ndarray) -> None:
    """Give each unknown word the class that is ``likeliest`` after the one before it; the first word's follows the last, an end that is known or guessed by itself."""
    at = np.flatnonzero(~known)
    if not len(at):
        return
    place = np.arange(len(of))
    last = np.maximum.accumulate(np.where(known, place, -1))[at]
    steps = np.where(last < 0, at + 1, at - last)
    found = of[np.where(last < 0, len(of) - 1, last)]
    # Steps by powers of two: after each, the table takes twice as many.
    while steps.any():
        odd = (steps & 1).astype(bool)
        found[odd] = likeliest[found[odd]]
        likeliest, steps = likeliest[likeliest], steps >> 1
    of[at] = found


def _total(part: tuple, table: pa.Table) -> pa.Table:
    """Counts of all texts for the words of each chunk, doubled, and odd in the first chunk that has the word."""
    order = np.argsort(table["chunk"].to_numpy())
    chunks = table["chunk"].to_numpy()[order]
    sent = [np.frombuffer(table["words"][i].as_py(), np.uint64) for i in order.tolist()]
    n = np.concatenate([_unpacked(table["counts"][i].as_py(), np.uint32) for i in order.tolist()])
    _, first, back = np.unique(np.concatenate(sent), return_index=True, return_inverse=True)
    total = 2 * np.bincount(back, n).astype(np.int64)[back]
    total[first] += 1
    return _replies(part, chunks, COUNTED, sent, total)


def _replies(part: tuple, chunks: np.ndarray, turn: int, sent: list[np.ndarray], values: np.ndarray) -> pa.Table:
    edges = np.concatenate(([0], np.cumsum([len(x) for x in sent]))).tolist()
    k = len(sent)
    blobs = [_packed(values[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "part": pa.array([part[0].as_py()] * k, pa.int32()), "turn": pa.array([turn] * k, pa.int32()), "reply": pa.array(blobs, pa.binary())})


def _moved(table: np.ndarray, half: int) -> Callable:
    """The part's kernel: new classes for the words of each chunk."""

    def move(part: tuple, sent: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.concatenate([_unpacked(x, kind) for x in sent[name].to_pylist()])

        words, classes = [np.frombuffer(x, np.uint64) for x in sent["words"].to_pylist()], column("classes", np.uint8)
        word, first, back = np.unique(np.concatenate(words), return_index=True, return_inverse=True)
        of, owner = classes[first] & (TRAINED - 1), np.repeat(back, column("sizes", np.uint8))
        code, at = np.unique(owner * KEYS + column("keys", np.uint8), return_inverse=True)
        n = np.bincount(at, column("counts", np.uint32), minlength=len(code)).astype(np.int64)
        new = better(table, of, code // KEYS, code % KEYS, n)
        left = (new == CLASSES) & (np.bincount(back, classes >= TRAINED) > 0)
        new[left] = (word[left] >> U64(8)) % U64(CLASSES)
        return _replies(part, sent["chunk"].to_numpy(), half, words, new[back])

    return move


def _h(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes times all bigrams, but for a term that no move changes."""
    return float(_h(table).sum() - _h(table.sum(0)).sum() - _h(table.sum(1)).sum())


def better(table: np.ndarray, of: np.ndarray, word: np.ndarray, key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Best class of each word against the matrix of class bigrams, from (word, key, count) in order of words; words without counts stay."""
    classes = len(table)
    cells = np.concatenate((table, table.T, np.diagonal(table)[None, :]))  # [key, class a word may enter]
    bare, sums = _h(cells), np.stack((table.sum(0), table.sum(1)))
    few = np.arange(SMALL + 1)[:, None]
    small, least = _h(cells + few[:, None]) - bare, [_h(n + few) - _h(n) for n in sums]

    def rows(tables, n, given):
        """For each count n what entering each class adds, from ``tables`` or, of larger ones, worked out."""
        out, large = tables(np.minimum(n, SMALL)), np.flatnonzero(n > SMALL)
        if len(large):
            out[large] = given(large, n[large, None])
        return out

    new, at = of.copy(), np.flatnonzero(of < classes)
    edges = np.searchsorted(word, np.arange(len(of) + 1))
    size = np.diff(edges)
    # After and before itself, by side 1 and 0: a class's counts as the first and as the second of a pair.
    beside = [np.bincount(word, np.where((key // classes == side) | (key == 2 * classes), count, 0), minlength=len(of)).astype(np.int64) for side in (0, 1)]
    # In its own class a word's counts are there already: what staying is worth is what leaving would cost.
    stay, own = np.zeros(len(of)), of[word].astype(np.int64)
    e = np.flatnonzero(own < classes)
    k, c, x = key[e], own[e], count[e]
    stay += np.bincount(word[e], 2 * bare[k, c] - _h(np.maximum(cells[k, c] - x, 0)) - _h(cells[k, c] + x), minlength=len(of))
    for n, b in zip(sums, beside, strict=True):
        n, b = n[of[at]], b[at]
        stay[at] -= 2 * _h(n) - _h(np.maximum(n - b, 0)) - _h(n + b)
    some = np.flatnonzero(size)
    for first in range(0, len(some), BLOCK):
        w = some[first : first + BLOCK]
        w = w[np.argsort(-size[w], kind="stable")]
        gain = np.zeros((len(w), classes))
        for b, n, t in zip(beside, sums, least, strict=True):
            gain -= rows(lambda x, t=t: t[x], b[w], lambda _, x, n=n: _h(n + x) - _h(n))
        active = np.searchsorted(-size[w], -np.arange(size[w[0]]))
        for j, m in enumerate(active.tolist()):
            e = edges[w[:m]] + j
            k = key[e]
            gain[:m] += rows(lambda x, k=k: small[x, k], count[e], lambda some, x, k=k: _h(cells[k[some]] + x) - bare[k[some]])
        here = np.flatnonzero(of[w] < classes)
        c = of[w[here]].astype(np.int64)
        gain[here, c] += stay[w[here]]
        best = gain.argmax(1)
        better_by = gain[np.arange(len(w)), best]
        better_by[here] -= gain[here, c] + 1e-9
        better_by[of[w] >= classes] = 1
        new[w] = np.where(better_by > 0, best, of[w])
    return new


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item, from the square matrix of item bigram counts, by moves that raise the mutual information."""
    k = len(bigrams)
    weight = bigrams.sum(0) + bigrams.sum(1)
    of = np.zeros(k, np.int64)
    order = np.argsort(-weight, kind="stable")
    of[order] = np.arange(k) % classes
    onto = np.zeros((k, classes))
    onto[np.arange(k), of] = 1
    to_class, from_class = bigrams @ onto, bigrams.T @ onto  # [item, class]: followed by it, follows it
    n = onto.T @ to_class

    def h(x):
        return x * np.log(np.maximum(x, 1e-300))

    for _ in range(sweeps):
        moves = 0
        for w in order.tolist():
            if weight[w] == 0:
                continue
            a, own = of[w], bigrams[w, w]
            row, col = to_class[w].copy(), from_class[w].copy()
            row[a] -= own
            col[a] -= own  # to and from other items of its class
            n[a] -= row
            n[:, a] -= col
            n[a, a] -= own
            out, into = n.sum(1), n.sum(0)
            r, c = row.sum() + own, col.sum() + own
            diagonal = np.arange(classes)
            # Entering class b changes row b and column b of n, and the sums of b.
            rows, cols = h(n + row[None, :]) - h(n), h(n + col[:, None]) - h(n)
            gain = rows.sum(1) - rows[diagonal, diagonal] + cols.sum(0) - cols[diagonal, diagonal]
            gain += h(n[diagonal, diagonal] + row + col + own) - h(n[diagonal, diagonal])
            gain -= h(out + r) - h(out) + h(into + c) - h(into)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            n[b] += row
            n[:, b] += col
            n[b, b] += own
            if b != a:
                moves += 1
                of[w] = b
                to_class[:, a] -= bigrams[:, w]
                to_class[:, b] += bigrams[:, w]
                from_class[:, a] -= bigrams[w]
                from_class[:, b] += bigrams[w]
        if not moves:
            break
    return of


def met(chunks: DataFrame, told: list[DataFrame], work: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """``work`` on each chunk and what it was told; the chunks stay where they are."""
    if told:
        replies = functools.reduce(DataFrame.union, told)
        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(work, schema)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(pa.table([c.slice(i, 1) for c in batch.columns], batch.schema.names), None).to_batches()

    return chunks.mapInArrow(rows, schema)


def summed(found: DataFrame, size: int) -> np.ndarray:
    """Of (k, n), the sum of every k."""
    out, rows = np.zeros(size), found.groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out[rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out


def cluster(chunks: DataFrame, parts: int, seeds: tuple[np.ndarray, np.ndarray], sweeps: int = SWEEPS) -> tuple[list[DataFrame], list[float]]:
    """The replies that tell the classes after sweeps of all words, begun from the classes of the seeds, and the information after each sweep."""
    spark, state, best, rises = chunks.sparkSession, {}, {}, []
    seeds = spark.sparkContext.broadcast(seeds)

    def matrix():
        found = met(chunks, list(state.values()), lambda row, replies: Chunk(row, parts, replies, seeds.value).bigrams(), "k long, n long")
        return summed(found, CLASSES * (CLASSES + 1))[: CLASSES**2].reshape(CLASSES, CLASSES)

    def moved(half):
        sent = met(chunks, list(state.values()), lambda row, replies: Chunk(row, parts, replies, seeds.value).contexts(half), CONTEXTS)
        return kept(sent.repartition(parts, "part").groupBy("part").applyInArrow(_moved(table, half), REPLY))

    table = matrix()
    for _ in range(sweeps):
        for half in range(HALVES):
            state = state | {half: moved(half)}
            table = matrix()
            # What a round has shuffled is not read again; Spark drops the files once the driver's JVM has collected their owners.
            gc.collect()
            spark.sparkContext._jvm.System.gc()
        value = information(table)
        if rises and value < rises[-1]:
            break
        rises.append(value)
        best = state
        # The whole information has another term, that of all bigrams, which no move changes.
        if len(rises) > 1 and rises[-1] - rises[-2] <= GAIN * (value + float(_h(table.sum()))):
            break
    return list(best.values()), rises


def score_texts(docs: DataFrame, modulus: int = MODULUS, remainder: int = REMAINDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of (doc_id: long, text: string)."""
    short_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    docs = docs.select("doc_id", "text", holds_out("doc_id", modulus, remainder).alias("held_out"))
    words = kept(docs.where("NOT held_out").select("text").mapInArrow(_counted, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    totals = words.agg(F.count("*").alias("v"), F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("long")).alias("s1"), F.sum((F.col("c") == 2).cast("long")).alias("s2")).first()
    chunks = kept(docs.mapInArrow(_chunked, CHUNKS))
    size = chunks.agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).first()
    texts, parts = int(size["texts"] or 0), int(size["n"] or 0) // SHARE + 1
    # Each chunk is dealt out once; in all rounds only what it is told moves.
    chunks = chunks.repartition(parts, "chunk").sortWithinPartitions("chunk").persist(StorageLevel.DISK_ONLY)
    sent = met(chunks, [], lambda row, _: Chunk(row, parts).counts(), "part int, chunk long, words binary, counts binary")
    known = kept(sent.repartition(parts, "part").groupBy("part").applyInArrow(_total, REPLY))
    table, types, state = np.zeros((CLASSES, CLASSES)), np.zeros(CLASSES), []
    n_all, v_all = int(totals["n"] or 0) + texts, int(totals["v"]) + (texts > 0)
    singles, doubles = int(totals["s1"] or 0) + (texts == 1), int(totals["s2"] or 0) + (texts == 2)
    discount = min(0.95, max(0.05, singles / (singles + 2 * doubles))) if singles + doubles else 0.5
    if texts:
        top = words.orderBy(F.desc("c"), "w").limit(FREQUENT).toArrow()["w"].to_numpy().view(np.uint64)
        items = sc.broadcast(np.sort(np.append(top, END)))
        among = summed(met(chunks, [], lambda row, _: Chunk(row, parts).bigrams(items.value), "k long, n long"), len(items.value) ** 2)
        seeds = items.value, exchange(among.reshape(len(items.value), -1))
        state, _ = cluster(chunks, parts, seeds)
        found = summed(met(chunks, [known, *state], lambda row, replies: Chunk(row, parts, replies).bigrams(), "k long, n long"), CLASSES * (CLASSES + 1))
        table, types = found[: CLASSES**2].reshape(CLASSES, CLASSES), found[CLASSES**2 :]
    n1 = table.sum(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        transition = np.log10((table + STRENGTH * n1[None, :] / max(n_all, 1)) / (table.sum(1)[:, None] + STRENGTH))
        unknown = np.log10(discount * types / n1)
        weight = np.log10(n1)
    # A class that training never met has no words; what falls there is as rare as an unknown word can be.
    floor = -np.log10(10.0 * (n_all + v_all + 1))
    transition = np.where(np.isfinite(transition), transition, floor)
    unknown, weight = np.where(np.isfinite(unknown), unknown, floor), np.where(np.isfinite(weight), weight, 0.0)
    below = np.log10(n_all + 0.1 * (v_all + 1))
    model = sc.broadcast((transition, weight, unknown, discount, below, texts > 0))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    rows = kept(met(chunks, [known, *state], lambda row, replies: Chunk(row, parts, replies).scores(*model.value), schema))
    chunks.unpersist()
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score")
