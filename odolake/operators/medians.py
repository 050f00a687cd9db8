"""Exact grouped medians for groups of any size, by radix selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.session import settle

#: Distinct values up to which a group is ranked as it is.
FEW = 4096
#: Parts a group's values are dealt into wherever they meet something known of the group.
SALTS = 16
#: Bits a selection step looks at: a step counts at most 65,536 prefixes for a wanted rank.
STEP = 16


def ordered_key(value: str) -> Column:
    """A whole number that orders doubles as they are ordered: sign times exponent and fraction bits. NaN comes last."""
    size = f"abs({value})"
    power = f"CAST(floor(log2({size})) AS INT)"
    # The logarithm may be off by one next to a power of two.
    exponent = f"({power} + CASE WHEN {size} >= 2D * pow(2D, {power}) THEN 1 WHEN {size} < pow(2D, {power}) THEN -1 ELSE 0 END)"
    normal = f"({exponent} + 1023) * {1 << 52}L + CAST(({size} / pow(2D, {exponent}) - 1D) * {1 << 52}D AS BIGINT)"
    tiny = f"CAST({size} * pow(2D, 537) * pow(2D, 537) AS BIGINT)"
    bits = (
        f"CASE WHEN {size} = DOUBLE('Infinity') THEN {2047 << 52}L WHEN {size} < pow(2D, -1022) THEN {tiny} ELSE {normal} END"
    )
    return F.expr(f"CASE WHEN isnan({value}) THEN {(1 << 63) - 1}L WHEN {value} < 0D THEN -({bits}) ELSE {bits} END")


def medians(df: DataFrame, by: Sequence[str], value: str, name: str = "median", count: str = "n") -> DataFrame:
    """Median of the readings of each group and their number, ``n``; missing readings don't count.

    A group without a reading keeps its row, with no median and ``n`` 0; groups with a NULL key are groups. No group is
    gathered in one place: values are counted first, groups of few distinct values are ranked, and
    the others, if there are any, are narrowed down in four steps of 16 bits of an order-preserving key, each of
    which counts the values by prefix and keeps the prefix that holds the wanted rank. The counts are settled when this is called.
    """
    key = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(by)])
    counted = settle(df.select(key.alias("_k"), F.col(value).cast("double").alias("_v")).groupBy("_k", "_v").agg(F.count(F.lit(1)).alias("_c")))
    read = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    sizes = counted.groupBy("_k").agg(F.sum(read).alias("_n"), F.count("_v").alias("_d"))
    dealt = counted.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
    if sizes.where(F.col("_d") > FEW).isEmpty():
        found = _ranked(counted)
    else:
        few = _ranked(dealt.join(_salted(sizes.where(F.col("_d") <= FEW)), ["_k", "_salt"]).select("_k", "_v", "_c"))
        found = few.unionByName(_selected(dealt, sizes.where(F.col("_d") > FEW)))
    names = [F.col(f"_k.c{i}").alias(c) for i, c in enumerate(by)]
    return found.select(*names, F.col("_n").alias(count), F.col("_m").alias(name))


def _salted(known: DataFrame) -> DataFrame:
    """What is known of a group, for each part of its values."""
    return known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _middle(n: Column) -> tuple[Column, Column]:
    return F.floor((n + 1) / 2), F.floor((n + 2) / 2)


def _ranked(rows: DataFrame) -> DataFrame:
    """Groups of at most ``FEW`` values: running counts in order."""
    whole = Window.partitionBy("_k")
    order = whole.orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    read = F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    placed = rows.withColumns({"_n": F.sum(read).over(whole), "_last": F.sum(read).over(order)}).withColumn("_first", F.col("_last") - read + 1)
    low, high = (F.max(F.when((F.col("_first") <= r) & (F.col("_last") >= r), F.col("_v"))) for r in _middle(F.col("_n")))
    return placed.groupBy("_k", "_n").agg(((low + high) / 2).alias("_m"))


def _selected(dealt: DataFrame, sizes: DataFrame) -> DataFrame:
    """Groups of many values: the prefixes that hold the middle ranks, sixteen bits at a time.

    Every step meets the values on group and part alone, so they are shuffled once for all steps; the prefix is a condition.
    """
    wanted = sizes.select("_k", "_n", F.explode(F.array_distinct(F.array(*_middle(F.col("_n"))))).alias("_rank"))
    state = wanted.withColumn("_target", F.col("_rank"))
    for left in range(64 - STEP, -1, -STEP):
        inside = dealt.join(_salted(state), ["_k", "_salt"]).withColumn("_key", ordered_key("_v"))
        if left < 64 - STEP:
            found = F.shiftright("_key", left + STEP)
            inside = inside.where((found >= F.col("_prefix")) & (found <= F.col("_prefix")))
        counts = prefix_counts(inside, left)
        upto = Window.partitionBy("_k", "_target").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        running = counts.withColumn("_last", F.sum("_c").over(upto))
        holding = running.where((F.col("_last") >= F.col("_rank")) & (F.col("_last") - F.col("_c") < F.col("_rank")))
        state = holding.select("_k", "_n", (F.col("_rank") - F.col("_last") + F.col("_c")).alias("_rank"), "_target", "_prefix", "_v")
        # The last step has found whole keys, so one value.
        if left:
            state = state.drop("_v")
    return state.groupBy("_k", "_n").agg(F.avg("_v").alias("_m"))


def prefix_counts(inside: DataFrame, left: int) -> DataFrame:
    """Values of a group by their key without its last ``left`` bits, for every wanted rank; missing readings count nothing."""
    prefix, read = F.shiftright("_key", left), F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)
    return inside.groupBy("_k", "_n", "_target", "_rank", prefix.alias("_prefix")).agg(F.sum(read).alias("_c"), F.max("_v").alias("_v"))
