"""Numbers that describe a document's form: which characters, words and lines it has and how often they repeat."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from odolake.llm.kernels import flat, line_spans, prefix_sums, span_hashes, word_spans

#: Classes of bytes: lower, upper, digit, blank, line end, sentence marks, ! and ?, other ASCII signs, beyond ASCII, control.
_CLASS = np.full(256, 9, np.uint8)
for _codes, _class in (
    (range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, 9), 3), ((10, 13), 4), (b".,;:'\"()-", 5), (b"!?", 6), (b"#$%&*+/<=>@[\\]^_`{|}~", 7), (range(128, 256), 8),
):
    _CLASS[list(_codes)] = _class
CLASSES = 10
#: Signs counted one by one besides their class.
_SIGNS = b"!|%$#&*@\\{}<>"
NAMES = (
    *(f"share_{i}" for i in range(CLASSES)), *(f"sign_{i}" for i in range(len(_SIGNS))),
    "log_chars", "log_words", "word_mean", "word_spread", "distinct_words", "log_distinct_words", "top_word", "same_as_before", "same_as_second_before",
    "distinct_pairs", "line_words", "distinct_lines", "marked_words", "upper_words",
)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per document the number of distinct hashes and the count of the most frequent one."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, doc))
    d, x = doc[order], h[order]
    first = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (x[1:] != x[:-1]))))
    runs = np.diff(np.concatenate((first, [len(x)])))
    most = np.zeros(n)
    np.maximum.at(most, d[first], runs)
    return np.bincount(d[first], minlength=n).astype(float), most


def describe(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; a null or empty text gives zeros."""
    data, offsets = flat(texts)
    n = len(texts)
    chars = np.diff(offsets).astype(float)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * 16 + _CLASS[data], minlength=16 * n).reshape(n, 16)[:, :CLASSES].astype(float)
    per_char = np.maximum(chars, 1)[:, None]
    rows = [counts / per_char]
    sign = np.zeros(256, np.uint8)
    sign[list(_SIGNS)] = np.arange(1, len(_SIGNS) + 1)
    some = np.flatnonzero(sign[data])
    rows.append(np.bincount(owner[some] * 16 + sign[data[some]] - 1, minlength=16 * n).reshape(n, 16)[:, : len(_SIGNS)] / per_char)
    starts, ends, doc = word_spans(data, offsets)
    sums, down = prefix_sums(data)
    h = span_hashes(sums, down, starts, ends)
    words = np.bincount(doc, minlength=n).astype(float)
    per_word = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(doc, length, n) / per_word
    spread = np.sqrt(np.maximum(np.bincount(doc, length**2, n) / per_word - mean**2, 0))
    distinct, most = _distinct(doc, h, n)

    def repeated(gap: int) -> np.ndarray:
        same = np.flatnonzero((h[gap:] == h[:-gap]) & (doc[gap:] == doc[:-gap])) + gap
        return np.bincount(doc[same], minlength=n) / per_word

    inside = np.flatnonzero(doc[1:] == doc[:-1])
    pairs, _ = _distinct(doc[inside], h[inside] * np.uint64(3) + h[inside + 1], n)
    line_start, line_end, line_doc = line_spans(data, offsets)
    full = line_end > line_start
    line_hash = span_hashes(sums, down, line_start[full], line_end[full])
    lines = np.maximum(np.bincount(line_doc[full], minlength=n), 1).astype(float)
    distinct_lines, _ = _distinct(line_doc[full], line_hash, n)
    last = _CLASS[data[ends - 1]] if len(ends) else np.zeros(0, np.uint8)
    head = _CLASS[data[starts]] if len(starts) else np.zeros(0, np.uint8)
    rows.append(np.column_stack((
        np.log1p(chars), np.log1p(words), mean, spread, distinct / per_word, np.log1p(distinct), most / per_word, repeated(1), repeated(2),
        pairs / per_word, np.log1p(words / lines), distinct_lines / lines,
        np.bincount(doc[(last == 6) | (last == 7)], minlength=n) / per_word, np.bincount(doc[head == 1], minlength=n) / per_word,
    )))
    return np.column_stack(rows)
