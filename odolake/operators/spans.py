"""Joins against intervals.

An interval is listed once per slice it touches, so the join runs on
``(key, slice)`` with the exact comparison as a residual. A key with very many
rows is spread over its slices, and pairs are only formed inside a slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odolake.operators.slices import SLICE, slice_of


def points_in_spans(
    points: DataFrame,
    at: str,
    spans: DataFrame,
    start: str,
    end: str,
    by: Sequence[str],
    width: int,
    how: str = "inner",
) -> DataFrame:
    """Join each point with the spans of its key that hold it, both ends included."""
    listed = spans.withColumn(SLICE, F.explode(F.sequence(slice_of(start, width), slice_of(end, width))))
    placed = points.withColumn(SLICE, slice_of(at, width)).alias("p")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in [*by, SLICE]]
    inside = F.col(f"p.{at}").between(F.col(f"s.{start}"), F.col(f"s.{end}"))
    cond = same[0]
    for c in [*same[1:], inside]:
        cond = cond & c
    joined = placed.join(listed.alias("s"), cond, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop(SLICE)
    keep_points = [F.col(f"p.{c}") for c in points.columns]
    keep_spans = [F.col(f"s.{c}") for c in spans.columns if c not in by]
    return joined.select(*keep_points, *keep_spans)


def overlapping(
    left: DataFrame,
    left_span: tuple[str, str],
    right: DataFrame,
    right_span: tuple[str, str],
    by: Sequence[str],
    width: int,
) -> DataFrame:
    """Pairs of overlapping intervals of the same key, each pair once.

    A pair is taken only in the first slice both touch, so no distinct is needed.
    """
    l_lo, l_hi = left_span
    r_lo, r_hi = right_span
    a = left.withColumn(SLICE, F.explode(F.sequence(slice_of(l_lo, width), slice_of(l_hi, width)))).alias("a")
    b = right.withColumn(SLICE, F.explode(F.sequence(slice_of(r_lo, width), slice_of(r_hi, width)))).alias("b")
    cond = F.col(f"a.{l_hi}") >= F.col(f"b.{r_lo}")
    cond = cond & (F.col(f"a.{l_lo}") <= F.col(f"b.{r_hi}"))
    for c in [*by, SLICE]:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    first_shared = F.greatest(slice_of(F.col(f"a.{l_lo}"), width), slice_of(F.col(f"b.{r_lo}"), width))
    pairs = a.join(b, cond & (F.col(f"a.{SLICE}") == first_shared))
    return pairs.select(
        *[F.col(f"a.{c}") for c in left.columns],
        *[F.col(f"b.{c}") for c in right.columns if c not in by],
    )
