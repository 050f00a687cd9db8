"""Vectorised text kernels: many documents at once as one byte array with offsets.

Words are runs of bytes other than ASCII white space, compared with A-Z lower-cased. A span's hash is
polynomial in its bytes over 64 bits, from prefix sums, followed by a mixer; equal spans hash equally
wherever they stand and on every machine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWERED = _BYTES[[b + 32 if 65 <= b <= 90 else b for b in range(256)]]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
MULTIPLIERS = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SALTS = _RNG.integers(0, 1 << 63, 4096, dtype=np.uint64)
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x = x * U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    with np.errstate(over="ignore"):
        up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the len+1 offsets into them; a null text is empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all words, in order."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    ink = ~WHITE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = ink[:-1]
    starts = np.flatnonzero(ink & (~before | cut[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = ink[1:]
    ends = np.flatnonzero(ink & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def prefix_sums(data: np.ndarray, lowered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Sums whose differences give span hashes, and the factors that undo a span's place."""
    n = len(data)
    up, down = _powers(max(16, int(n + 1).bit_length()))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWERED if lowered else _BYTES)[data] * up[:n], out=sums[1:])
    return sums, down


def span_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def spans_summed(data: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans that are not empty, without sums from the beginning: for few spans of each byte."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, _ = _powers(max(16, int(len(data) + 1).bit_length()))
    terms = np.append(_BYTES[data] * up[: len(data)], U64(0))
    return mix(np.add.reduceat(terms, np.stack((starts, ends), axis=1).ravel())[::2] * down[starts] + (ends - starts).astype(np.uint64))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and where each document's words begin (len+1 entries)."""
    data, offsets = flat(texts)
    starts, ends, doc = word_spans(data, offsets)
    sums, down = prefix_sums(data)
    return span_hashes(sums, down, starts, ends), np.searchsorted(doc, np.arange(len(offsets)))


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Per text the sorted hashes of its distinct k-word shingles.

    Fewer than k words make one shingle of the whole sequence; no word makes none. A shingle is told by
    64 bits, so two different ones are taken for equal once in about 10^19 comparisons.
    """
    h, at = words(texts)
    out, none = [], np.zeros(0, np.uint64)
    n = max(0, len(h) - k + 1)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += h[j : j + n] * MULTIPLIERS[j]
    rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            whole = (h[a:b] * MULTIPLIERS[: b - a]).sum(dtype=np.uint64) + U64(b - a)
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(none)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of all lines as split at line feeds; an empty text has one empty line."""
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, feeds, "right") - 1
    doc = np.concatenate((np.arange(n), owner))
    starts = np.concatenate((offsets[:-1], feeds + 1))
    order = np.lexsort((starts, doc))
    ends = np.concatenate((offsets[1:], feeds))
    return starts[order], ends[np.lexsort((ends, doc))], doc[order]
