"""Shards by weighted rendezvous hashing.

Every shard draws a number for a record's key, u in (0, 1) from an md5 of key and shard, and scores -weight / ln(u); the
highest score takes the record. A shard's draw doesn't depend on the others, so a new shard takes exactly the records
it wins and a shard that goes gives up only its own; shares are as the weights. The draws are built-in expressions on the
record alone: dealing shuffles nothing.

``slots`` numbers the records of a shard from 0 without gaps, in the order of the md5 of their key, which is also a random
order to read them in. Equal records are counted before the first shuffle, buckets are the first ``DIGITS`` hex digits of
that md5, and only one row for each bucket passes the window over a shard; so no key, however common, and no shard lands
in one task as rows. ``write_shards`` writes the records themselves, a folder for each shard, several files where it is large.

Law ``key``: a record's shard follows from its key and the number and weights of the shards. Equal texts under different
keys may part; take the text's hash as the key to keep them together.

Defined cases: a null text has no bytes, a null key is hashed as an empty one. Repeated rows get slots of their own. An empty
table gives no rows. Columns of the same names as the operator's own are not read by ``sized``; ``dealt`` replaces them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from odolake.llm.common import kept

SHARDS, OVERHEAD, DIGITS = 40, 16, 3
#: So many rows of one record are written out by one task.
RUN = 1 << 16
_DRAW = 1 << 52


def _key_text(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def _score(key: str, shard: int, weight: float) -> Column:
    """A shard's score for a key and, for ties, the draw itself and the lower number."""
    drawn = F.conv(F.substring(F.md5(F.concat(_key_text(key), F.lit(f":{shard}"))), 1, 13), 16, 10).cast("long")
    u = (drawn + F.lit(0.5)) / F.lit(float(_DRAW))
    return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), drawn.alias("drawn"), F.lit(-shard).alias("shard"))


def dealt(records: DataFrame, key: str, weights: Sequence[float], grown: float | None = None) -> DataFrame:
    """The records with their shard and, if ``grown`` is the weight of one more shard, with grown_shard."""
    scores = [_score(key, i, w) for i, w in enumerate(weights)]
    best = F.greatest(*scores) if len(scores) > 1 else scores[0]
    out = records.withColumn("_best", best)
    shard = (-F.col("_best.shard")).cast("int")
    if grown is None:
        return out.withColumn("shard", shard).drop("_best")
    more = _score(key, len(weights), grown)
    return (
        out.withColumn("grown_shard", F.when(more > F.col("_best"), F.lit(len(weights))).otherwise(shard).cast("int"))
        .withColumn("shard", shard)
        .drop("_best")
    )


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size and text_crc32 of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))


def slots(records: DataFrame, key: str) -> DataFrame:
    """The records with their slot in their shard: in the order of the key's md5, then of the other columns."""
    columns = records.columns
    place = F.md5(_key_text(key))
    # Equal records share a row until they are written out, so a common key is one row for each task before the shuffle.
    counted = records.groupBy(*columns).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_place", place)
    counted = kept(counted.withColumn("_bucket", F.substring("_place", 1, DIGITS)))
    totals = counted.groupBy("shard", "_bucket").agg(F.sum("_rows").alias("_held"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_place", *[F.asc_nulls_first(c) for c in columns])
    ahead = F.coalesce(F.sum("_rows").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_ahead", ahead).join(starts, ["shard", "_bucket"]).withColumn("_first", F.col("_start") + F.col("_ahead"))
    few = placed.where(F.col("_rows") <= RUN).withColumn("_run", F.lit(0).cast("long"))
    many = placed.where(F.col("_rows") > RUN).withColumn("_run", F.explode(F.expr(f"sequence(0L, (_rows - 1) div {RUN})"))).repartition("shard", "_first", "_run")
    rest = F.least(F.lit(RUN), F.col("_rows") - F.col("_run") * RUN)
    numbered = few.unionByName(many).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), rest - 1)))
    return numbered.select(*columns, (F.col("_first") + F.col("_run") * RUN + F.col("_i")).alias("slot"))


def write_shards(records: DataFrame, key: str, weights: Sequence[float], path: str, files: int = 1) -> DataFrame:
    """Write whole records to ``path``/shard=<number>/, ``files`` files for each shard, and return rows and files by shard.

    The rows of an input task go to a shard's files in turn, so a common key fills no file alone; inside a file they are
    ordered by the md5 of their key. A repeated run replaces what an interrupted one left.
    """
    part = F.monotonically_increasing_id() % files
    rows = dealt(records, key, weights).withColumn("_part", part).withColumn("_place", F.md5(_key_text(key)))
    dealt_out = rows.repartition(len(weights) * files, "shard", "_part").sortWithinPartitions("shard", "_part", "_place").drop("_part", "_place")
    dealt_out.write.mode("overwrite").partitionBy("shard").parquet(path)
    written = records.sparkSession.read.parquet(path)
    return written.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("_metadata.file_path").alias("files"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Law ``key`` over equal shards: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    records = dealt(sized(docs), "doc_id", [1.0] * shards, grown=1.0)
    return slots(records, "doc_id").select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
