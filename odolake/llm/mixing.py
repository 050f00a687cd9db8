"""Mixing sources to target weights by pivotal dependent rounding.

A source is to give ``target`` of its ``source_size`` words, so each of its documents has the same fractional number of
copies, at most three. The whole part is fixed. The fractions are rounded in pairs: two documents that are still open
exchange words, in a random direction chosen so that neither's expected number changes, until one of them is in or out as
a whole; the other meets the next. The sum of words is kept at every step. This runs in chunks of about ``CHUNK``
documents; what each leaves open, one document at most, is combined in a tree of ``FAN`` chunks a node until one
document of a source is left, which is drawn by its fraction. So a source misses its target by less than that document.

Sources are ordered by code point, null last, and weigh 5, 2, 1, 5, 2, 1 ...; a target stops at three times the source's
size and the excess goes to the others by weight.

Defined cases: a null or empty text has size 0, takes nothing and is drawn by a hash of its id where copies are wanted.
A source of size 0 has target 0. A null source is a source. Repeated rows are documents of their own. An empty table
gives no rows. Every draw is seeded by what it is about, so reruns agree. Other columns are not read.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.llm.common import kept

CHUNK, FAN, MOST, SEED = 8192, 256, 3, 17
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def text_hash() -> Column:
    """With doc_id and source, tells rows apart that aren't repeats."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", text_hash().alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target), one row for each source.

    The least level L with sum of min(most * size, L * weight) equal to all words: sources are taken in the order in which
    a rising level reaches their limit. One row for each source goes through the window.
    """
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = grouped.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    weighed = placed.withColumn("w", weight).withColumn("top", F.col("source_size") * float(most)).withColumn("reached", F.col("top") / F.col("w"))
    order = Window.orderBy("reached", "i")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0))) / F.sum("w").over(on)
    # The first source, in this order, that the level computed without those before it doesn't fill.
    found = weighed.withColumn("level", level).withColumn("final", F.min(F.when(F.col("level") <= F.col("reached"), F.struct("reached", "i", "level"))).over(whole))
    return found.select("source", "source_size", F.least(F.col("top"), F.col("final.level") * F.col("w")).alias("target"))


def settle_chunk(sizes: list[int], mass: list[float], rng: random.Random) -> tuple[list[int], int | None, float]:
    """1 or 0 for each document, then the open one, if any, and its mass. Sizes are positive, masses between 0 and size."""
    taken, open_, held = [0] * len(sizes), None, 0.0
    for j, (size, m) in enumerate(zip(sizes, mass, strict=True)):
        tiny = 1e-9 * size
        if m <= tiny or m >= size - tiny:
            taken[j] = int(m > tiny)
            continue
        if open_ is None:
            open_, held = j, m
            continue
        gain, loss = min(sizes[open_] - held, m), min(size - m, held)
        change = gain if rng.random() * (gain + loss) < loss else -loss
        held, m = held + change, m - change
        done = []
        for k, v in ((open_, held), (j, m)):
            small = 1e-9 * sizes[k]
            if v <= small or v >= sizes[k] - small:
                taken[k] = int(v > small)
            else:
                done.append((k, v))
        open_, held = done[0] if done else (None, 0.0)
    return taken, open_, held


def _round(frame: pd.DataFrame) -> pd.DataFrame:
    """Settle one chunk; at most one row keeps a fraction strictly between 0 and 1."""
    frame = frame.sort_values(["size", "doc_id", "text_hash"], ascending=[False, True, True], kind="stable", ignore_index=True)
    rng = random.Random(f"{SEED} {frame['source'].iloc[0]} {frame['chunk'].iloc[0]} {len(frame)}")
    sizes = frame["size"].tolist()
    taken, open_, held = settle_chunk(sizes, (frame["frac"] * frame["size"]).tolist(), rng)
    out = [float(x) for x in taken]
    if open_ is not None:
        out[open_] = held / sizes[open_]
        if frame["last"].iloc[0]:
            out[open_] = float(rng.random() < out[open_])
    frame["frac"] = out
    return frame


def mix(docs: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, source, text_hash for every row of (doc_id: long, text: string, source: string)."""
    sizes = kept(sized(docs))
    wanted = kept(targets(sizes))
    chunks = max(1, -(-sizes.count() // chunk))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = (
        sizes.withColumnRenamed("source", "_s").join(wanted, F.col("_s").eqNullSafe(F.col("source"))).drop("_s")
        .withColumn("base", F.floor(ratio + 1e-12).cast("long"))
        .withColumn("frac", F.greatest(F.lit(0.0), ratio - F.col("base")))
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash", F.lit(SEED)), 11) / F.lit(float(1 << 53))
    none = joined.where("size = 0").withColumn("frac", (place < F.col("frac")).cast("double"))
    columns = ["doc_id", "source", "text_hash", "size", "source_size", "target", "base", "frac"]
    done = [none.select(*columns)]
    level = joined.where("size > 0").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(SEED + 1)), F.lit(chunks)))
    schema = "doc_id long, source string, text_hash long, size long, source_size long, target double, base long, frac double, chunk long, last boolean"
    while True:
        level = level.withColumn("last", F.lit(chunks == 1)).groupBy("source", "chunk").applyInPandas(_round, schema)
        if chunks == 1:
            done.append(level.select(*columns))
            break
        level = kept(level)
        is_open = "frac > 0 AND frac < 1"
        done.append(level.where(f"NOT ({is_open})").select(*columns))
        chunks = -(-chunks // fan)
        level = level.where(is_open).withColumn("chunk", F.floor(F.col("chunk") / fan).cast("long"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.union(more)
    rows = rows.withColumn("copies", F.col("base") + F.col("frac").cast("long"))
    return rows.selectExpr("doc_id", "size", "source_size", "target", "copies * size AS taken", "copies", "source", "text_hash")
