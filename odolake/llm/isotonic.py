"""Isotonic calibration from counts in fixed bins: pool adjacent violators."""

from __future__ import annotations

import numpy as np


def pooled(positives: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """A never falling rate for each bin that is closest to the counts; bins without rows take what lies between.

    One row of each label is added at the overall rate, so no rate is exactly 0 or 1.
    """
    total = totals.sum()
    if total == 0:
        return np.full(len(totals), 0.5)
    base = (positives.sum() + 0.5) / (total + 1)
    blocks: list[list[float]] = []  # positives, rows, bins
    at = np.flatnonzero(totals)
    for i in at:
        blocks.append([float(positives[i]), float(totals[i]), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for k in range(3):
                blocks[-1][k] += last[k]
    rates = np.concatenate([np.full(int(b[2]), (b[0] + base) / (b[1] + 1)) for b in blocks])
    return np.maximum.accumulate(np.interp(np.arange(len(totals)), at, rates))
