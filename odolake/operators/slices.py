"""Ordered operators that never put a whole key into one task.

A plain window over ``(vehicle, boot)`` sorts everything that key holds in one
task, so one long recording decides how long the job takes. Each operator here
cuts the key's axis (a clock or a sequence number) into *slices* of a fixed
width, works inside ``(key, slice)``, and moves what has to cross a slice edge
through a summary of one row per slice. The summary is bounded by the length of
the axis, not by the number of rows.

Key columns must not be NULL: rows with a NULL key match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def slice_of(key: Column | str, width: int) -> Column:
    """Number of the slice a key value falls in; also right for negative keys."""
    col = F.col(key) if isinstance(key, str) else key
    return F.floor(col / F.lit(width)).cast("long")


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def place_in_slice(first: str | Column, second: str | Column | None, width: int, descending: bool = False) -> Column:
    """One long that orders rows of a slice by two numbers.

    As a plain number it keeps the aggregates that pick a slice's edge row on the hash
    path; ordering by a struct would sort all rows first. The second number may use
    all bits the slice width leaves, 46 for a minute in milliseconds.
    """
    a = F.col(first) if isinstance(first, str) else first
    if second is None:
        return a.cast("long")
    b = F.col(second) if isinstance(second, str) else second
    room = 1 << (62 - width.bit_length())
    inside = (a - slice_of(a, width) * width).cast("long")
    return inside * room + ((room - 1 - b) if descending else b)


def edge_row(cols: Sequence[str], rank: Column, last: bool, prefix: str) -> list[Column]:
    """Aggregates that pick the row with the largest (smallest) rank, one column at a time."""
    pick = F.max_by if last else F.min_by
    return [pick(c, rank).alias(f"{prefix}{i}") for i, c in enumerate(cols)]


def rebuilt(names: Sequence[str], prefix: str) -> Column:
    """The picked columns as a struct with the given field names."""
    return F.struct(*[F.col(f"{prefix}{i}").alias(n) for i, n in enumerate(names)])


def _rank(order: Sequence[str | Column], key: str | Column, width: int) -> Column:
    if len(order) == 1:
        return place_in_slice(order[0], None, width)
    if len(order) == 2 and isinstance(key, str) and order[0] == key:
        return place_in_slice(order[0], order[1], width)
    return F.struct(*_cols(order))


def row_numbers(
    df: DataFrame, by: Sequence[str], order: Sequence[str], key: str | Column, width: int, name: str = "rn"
) -> DataFrame:
    """``row_number() over (partition by .. order by ..)`` as local numbers plus slice offsets.

    ``key`` must be monotone in ``order`` (usually its first column).
    """
    sliced = df.withColumn(SLICE, slice_of(key, width))
    sizes = sliced.groupBy(*by, SLICE).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, SLICE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*by, SLICE).orderBy(*_cols(order))
    numbered = sliced.withColumn("_local", F.row_number().over(local))
    return (
        numbered.join(offsets, [*by, SLICE])
        .withColumn(name, (F.col("_local") + F.col("_offset")).cast("long"))
        .drop("_local", "_offset", SLICE)
    )


def neighbour(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    key: str | Column,
    width: int,
    cols: Sequence[str],
    name: str,
    following: bool = False,
) -> DataFrame:
    """Add the previous (or following) row of the key as a struct column, NULL at the end."""
    sliced = df.withColumn(SLICE, slice_of(key, width))
    packed = F.struct(*[F.col(c) for c in cols])
    rank = _rank(order, key, width)
    edges = sliced.groupBy(*by, SLICE).agg(*edge_row(cols, rank, not following, "_e"))
    along = Window.partitionBy(*by).orderBy(SLICE)
    step = F.lead if following else F.lag
    carried = edges.select(*by, SLICE, step(rebuilt(cols, "_e")).over(along).alias("_carry"))
    local = Window.partitionBy(*by, SLICE).orderBy(*_cols(order))
    return (
        sliced.withColumn("_local", step(packed).over(local))
        .join(carried, [*by, SLICE])
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", SLICE)
    )


def near_neighbours(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    key: str,
    reach: int,
    width: int,
    cols: Sequence[str],
    before: str | None = None,
    after: str | None = None,
) -> DataFrame:
    """Previous / next row, guaranteed only when it lies within ``reach`` of the row on ``key``.

    Rows near a slice edge are copied into the slice next door, so one shuffle is
    enough. A neighbour further away than ``reach`` may come back as NULL.
    """
    copies = with_edge_copies(df, key, width, before=reach, after=reach)
    local = Window.partitionBy(*by, SLICE).orderBy(*_cols(order))
    packed = F.struct(*[F.col(c) for c in cols])
    out = copies
    if before:
        out = out.withColumn(before, F.lag(packed).over(local))
    if after:
        out = out.withColumn(after, F.lead(packed).over(local))
    return out.where(F.col(SLICE) == slice_of(key, width)).drop(SLICE)


def with_edge_copies(df: DataFrame, key: str | Column, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """One row per slice that can see the row.

    ``before`` copies a row into the previous slice when it lies in the first
    ``before`` units of its own; ``after`` into the next when in the last ``after``.
    """
    col = F.col(key) if isinstance(key, str) else key
    first = slice_of(col - F.lit(before), width) if before else slice_of(col, width)
    last = slice_of(col + F.lit(after), width) if after else slice_of(col, width)
    return df.withColumn(SLICE, F.explode(F.sequence(first, last)))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    key: str | Column,
    width: int,
    aggs: Mapping[str, tuple[str, Column]],
    exclusive: bool = False,
) -> DataFrame:
    """Running ``sum`` / ``max`` / ``min`` / ``last`` (non-null) per key in the given order."""
    sliced = df.withColumn(SLICE, slice_of(key, width))
    for n, (_, expr) in aggs.items():
        sliced = sliced.withColumn(f"_in_{n}", expr)
    rank = _rank(order, key, width)
    whole = {"sum": F.sum, "max": F.max, "min": F.min}

    def total(kind: str, n: str) -> Column:
        col = F.col(f"_in_{n}")
        if kind == "last":
            return F.max_by(col, F.when(col.isNotNull(), rank))
        return whole[kind](col)

    per = sliced.groupBy(*by, SLICE).agg(*[total(k, n).alias(f"_t_{n}") for n, (k, _) in aggs.items()])
    earlier = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)

    def over(kind: str, col: str, window) -> Column:
        if kind == "last":
            return F.last(col, ignorenulls=True).over(window)
        return whole[kind](col).over(window)

    carry = per.select(*by, SLICE, *[over(k, f"_t_{n}", earlier).alias(f"_c_{n}") for n, (k, _) in aggs.items()])
    upto = -1 if exclusive else Window.currentRow
    local = Window.partitionBy(*by, SLICE).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, upto)
    out = sliced
    for n, (kind, _) in aggs.items():
        out = out.withColumn(f"_l_{n}", over(kind, f"_in_{n}", local))
    out = out.join(carry, [*by, SLICE])
    join = {
        "sum": lambda a, b: F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
            F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
        ),
        "max": lambda a, b: F.greatest(a, b),
        "min": lambda a, b: F.least(a, b),
        "last": lambda a, b: F.coalesce(a, b),
    }
    for n, (kind, _) in aggs.items():
        out = out.withColumn(n, join[kind](F.col(f"_l_{n}"), F.col(f"_c_{n}")))
    drop = [SLICE] + [f"{p}_{n}" for n in aggs for p in ("_in", "_l", "_c")]
    return out.drop(*drop)


def number_sessions(slices: DataFrame, by: Sequence[str], first: str, last: str, gap: int, name: str) -> DataFrame:
    """Number the sessions of a key from per-slice spans ``[first, last]`` in one unit of time.

    A session breaks where more than ``gap`` passes between one slice's last and the
    next slice's first value. The slice width must not exceed ``gap``, so that no
    break can fall inside a slice. Input: one row per key and slice.
    """
    along = Window.partitionBy(*by).orderBy(SLICE)
    opens = F.when(F.col(first) - F.lag(last).over(along) > gap, 1).otherwise(0)
    marked = slices.withColumn("_opens", opens)
    total = F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn(name, (total + 1).cast("long")).drop("_opens")
