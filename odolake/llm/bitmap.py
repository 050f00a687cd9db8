"""A fixed-size bitmap of keys, to keep rows that cannot match away from a shuffle.

It has at most ``1 << BITS`` bits whatever the number of keys, so it may be broadcast. A full one lets every
row through: the exact join that follows decides, the bitmap only saves work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def bitmap(keys: DataFrame, column: str, hashed: bool = True) -> np.ndarray:
    """Set the bit of every key; at most 262,144 words of 64 bits reach the driver.

    Keys that are hash values themselves need no hashing (``hashed`` false); then ``maybe`` takes the key.
    """
    place = keys.select((F.xxhash64(column) if hashed else F.col(column)).bitwiseAND(F.lit((1 << BITS) - 1)).alias("p"))
    words = place.selectExpr("shiftright(p, 6) AS w", "shiftleft(1L, CAST(p & 63 AS INT)) AS v")
    found = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[found["w"].to_numpy()] = found["v"].to_numpy()
    return out


def maybe(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Whether keys may be among those set, by their places: the keys' xxhash64, or the keys themselves if they weren't hashed."""
    at = place & ((1 << BITS) - 1)
    return (bits[at >> 6] >> (at & 63)) & 1 == 1
