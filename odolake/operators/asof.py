"""As-of joins: each left row gets the nearest right row before or after it.

Left and right rows are put into one relation, shuffled once on
``(key, slice)``, sorted, and matched by a running ``last`` over each slice.
There is no fan-out and no join. What a slice needs from outside itself comes

* for a match with a known reach (``within``) from copies of the right rows near
  the slice edge;
* for an unlimited match from a carried row per slice: the last right row of the
  slices before it, found on a summary of one row per slice.

Right columns travel in one struct, so a NULL reading in the nearest row stays
NULL and does not fall through to an older one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.operators.slices import SLICE, edge_row, place_in_slice, rebuilt, slice_of, with_edge_copies

MINUTE_MS = 60_000


@dataclass(frozen=True)
class Side:
    """One right side: its rows, the columns to bring along and how to match them."""

    name: str
    rows: DataFrame
    cols: Sequence[str]
    forward: bool = False
    within: int | None = None
    where: Column | None = field(default=None)


def asof(
    left: DataFrame,
    sides: Sequence[Side],
    by: Sequence[str],
    on: str = "mono_ms",
    tie: str = "seq",
    width: int = MINUTE_MS,
    strict_order: bool = False,
) -> DataFrame:
    """Match every left row with one row of each side; adds a struct column per side.

    Backward takes the latest right row at or before the left row, forward the
    earliest at or after it; among right rows at the same ``on`` the largest ``tie``
    wins. ``Side.where`` filters right rows before the match. With ``within`` a
    match further away than that is NULL. ``strict_order`` ranks rows with equal
    ``on`` by ``tie`` instead of letting every right row at that instant count.
    """
    left_cols = left.columns
    left_rows = left.select(
        *by,
        F.col(on).alias("_on"),
        F.col(tie).alias("_tie") if tie in left_cols else F.lit(0).cast("long").alias("_tie"),
        F.lit(1).alias("_rank"),
        slice_of(on, width).alias(SLICE),
        F.struct(*[F.col(c) for c in left_cols]).alias("_left"),
    )
    parts = [left_rows]
    open_sides: list[tuple[Side, DataFrame]] = []
    for side in sides:
        rows = side.rows if side.where is None else side.rows.where(side.where)
        cols = [on] + [c for c in side.cols if c != on]
        rows = rows.select(
            *by,
            F.col(on).alias("_on"),
            F.col(tie).alias("_tie"),
            F.lit(0).alias("_rank"),
            F.struct(*[F.col(c) for c in cols]).alias(side.name),
        )
        if side.within is None:
            rows = rows.withColumn(SLICE, slice_of("_on", width))
            open_sides.append((side, rows))
        elif side.forward:
            rows = with_edge_copies(rows, "_on", width, before=side.within)
        else:
            rows = with_edge_copies(rows, "_on", width, after=side.within)
        parts.append(rows)
    if open_sides:
        parts.extend(_carried(left_rows, open_sides, by, width))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)

    first = ["_tie", "_rank"] if strict_order else ["_rank", "_tie"]
    ahead = Window.partitionBy(*by, SLICE).orderBy("_on", *first)
    last = [F.desc("_tie"), F.asc("_rank")] if strict_order else [F.asc("_rank"), F.asc("_tie")]
    behind = Window.partitionBy(*by, SLICE).orderBy(F.desc("_on"), *last)
    for side in sides:
        window = behind if side.forward else ahead
        window = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn(side.name, F.last(side.name, ignorenulls=True).over(window))
    rows = rows.where(F.col("_left").isNotNull())
    out = rows.select("_left.*", *[_in_reach(side, on) for side in sides])
    return out


def _in_reach(side: Side, on: str) -> Column:
    found = F.col(side.name)
    if side.within is None:
        return found
    away = F.abs(F.col("_on") - found[on])
    return F.when(away <= side.within, found).alias(side.name)


def _carried(
    left_rows: DataFrame, sides: Sequence[tuple[Side, DataFrame]], by: Sequence[str], width: int
) -> list[DataFrame]:
    """Synthetic right rows at the edge of each slice, holding the last match outside it."""
    seen = left_rows.select(*by, SLICE)
    fields: dict[str, list[str]] = {}
    for side, rows in sides:
        # The larger tie wins in both directions.
        rank = place_in_slice("_on", "_tie", width, descending=side.forward)
        fields[side.name] = rows.schema[side.name].dataType.fieldNames()
        flat = [F.col(f"{side.name}.{c}").alias(f"_{side.name}_{c}") for c in fields[side.name]]
        seen = seen.unionByName(rows.select(*by, SLICE, *flat, rank.alias(f"_k_{side.name}")), allowMissingColumns=True)
    picks = []
    for side, _ in sides:
        cols = [f"_{side.name}_{c}" for c in fields[side.name]]
        picks += edge_row(cols, F.col(f"_k_{side.name}"), not side.forward, f"_e_{side.name}_")
        picks.append(F.count(f"_k_{side.name}").alias(f"_n_{side.name}"))
    per_slice = seen.groupBy(*by, SLICE).agg(*picks)
    packed = {n: F.when(F.col(f"_n_{n}") > 0, rebuilt(names, f"_e_{n}_")).alias(n) for n, names in fields.items()}
    per_slice = per_slice.select(*by, SLICE, *packed.values())
    out = []
    for side, _ in sides:
        order = F.desc(SLICE) if side.forward else F.asc(SLICE)
        outside = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        edge = (F.col(SLICE) + 1) * width if side.forward else F.col(SLICE) * width - 1
        out.append(
            per_slice.withColumn(side.name, F.last(side.name, ignorenulls=True).over(outside))
            .where(F.col(side.name).isNotNull())
            .select(
                *by,
                edge.alias("_on"),
                F.lit(0).cast("long").alias("_tie"),
                F.lit(0).alias("_rank"),
                SLICE,
                side.name,
            )
        )
    return out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    cols: Sequence[str],
    on: str = "mono_ms",
    tie: str = "seq",
    forward: bool = False,
    within: int | None = None,
    where: Column | None = None,
    how: str = "left",
    width: int = MINUTE_MS,
    prefix: str = "right_",
) -> DataFrame:
    """As-of join of one right side with flat output: left columns, prefixed right columns, ``age_ms``."""
    side = Side("_match", right, cols, forward=forward, within=within, where=where)
    out = asof(left, [side], by, on=on, tie=tie, width=width)
    if how == "inner":
        out = out.where(F.col("_match").isNotNull())
    age = F.abs(F.col(on) - F.col(f"_match.{on}"))
    return out.select(
        *left.columns, *[F.col(f"_match.{c}").alias(prefix + c) for c in cols], age.alias("age_ms")
    )
