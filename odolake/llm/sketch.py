"""Fast similarity sketching of sets of 64-bit items.

A sketch has ``COORDINATES`` coordinates, filled in rounds: in round i each item is hashed to one bin and a value, and an
empty bin takes the smallest value it gets. After as many rounds as there are bins, a bin that is still empty takes the smallest
value of all items under a hash of its own. So every coordinate is filled, a large set needs one or two rounds, and two sets agree
on a coordinate with probability equal to their similarity, as concentrated as with independent permutations.
"""

from __future__ import annotations

import numpy as np

from odolake.llm.kernels import SALTS, U64, mix

COORDINATES = 128
_BIN = U64(57)
_LOW50 = U64((1 << 50) - 1)
_TOP7 = U64(((1 << 7) - 1) << 57)


def fast_sketch(items: np.ndarray) -> np.ndarray:
    """The 128 coordinates of a set of 64-bit items that is not empty."""
    out, filled = np.zeros(COORDINATES, np.uint64), np.zeros(COORDINATES, bool)
    step = min(COORDINATES, max(1, 512 // len(items)))
    for begin in range(0, COORDINATES, step):
        rounds = np.arange(begin, min(COORDINATES, begin + step))
        value = mix(items[None, :] ^ SALTS[rounds][:, None])
        key = (value & _TOP7) | ((rounds - begin).astype(np.uint64) << U64(50))[:, None] | ((value >> U64(7)) & _LOW50)
        key = np.sort(key, axis=None)
        bins = key >> _BIN
        first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
        at = bins[first].astype(np.int64)
        new = ~filled[at]
        got = key[first[new]]
        turn = ((got >> U64(50)) & U64(127)) + U64(begin)
        out[at[new]] = (turn << U64(50)) | (got & _LOW50)
        filled[at[new]] = True
        if filled.all():
            return out
    for b in np.flatnonzero(~filled):
        least = mix(items ^ SALTS[COORDINATES + b]).min()
        out[b] = (U64(COORDINATES) << U64(50)) | ((least >> U64(7)) & _LOW50)
    return out
