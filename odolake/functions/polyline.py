"""Encoded polyline text for one coordinate step, as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the encoding: 5-bit groups, low group first, bit 5 set while more follow, offset 63.
GROUP_BITS = 5
MORE = 32
OFFSET = 63
MAX_GROUPS = 7


def encoded_step(step: Column) -> Column:
    """Text of one signed whole-number step: the sign moves to the lowest bit, then 5-bit groups.

    NULL for a step that ``MAX_GROUPS`` groups can't hold; coordinates need six.
    """
    zigzag = F.when(step < 0, -2 * step - 1).otherwise(2 * step).cast("long")
    size = F.pow(F.lit(2), F.lit(GROUP_BITS)).cast("long")
    out = F.lit("")
    rest = zigzag
    for i in range(MAX_GROUPS):
        higher = F.floor(rest / size).cast("long")
        digit = rest % size + F.when(higher > 0, MORE).otherwise(0) + OFFSET
        wanted = F.lit(True) if i == 0 else rest > 0
        out = F.concat(out, F.when(wanted, F.chr(digit)).otherwise(""))
        rest = higher
    return F.when(rest == 0, out)
