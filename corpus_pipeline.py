"""A training-data pipeline over the documents table: five stages, each over all its predecessor kept.

Each function takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from odolake.llm import lines, minhash, mixing, packing, quality
from odolake.llm.common import kept, table

#: File name of the tokenizer among the public ones.
TOKENIZER = "word_bpe_49k.json"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; a document without an id is scored but has no verdict, and stays.

    Rows that share an id share a verdict: they go only if every one of their texts is rejected.
    """
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    rejected = scored.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("predicted").alias("best")).where("best = 0").select("doc_id")
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of fuzzy equal lines one stays, the first; n_chars follows the text."""
    text = lines.dedup_lines(docs)
    return text.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the smallest id stays."""
    away = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(away, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    # Equal rows of one document share what they get together.
    key = ["doc_id", "source", "text_hash"]
    taken = mixing.mix(docs).groupBy(*key).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    same = F.expr("d.doc_id <=> t.doc_id AND d.source <=> t.source AND d.text_hash = t.text_hash")
    joined = docs.withColumn("text_hash", mixing.text_hash()).alias("d").join(kept(taken).alias("t"), same)
    number = F.row_number().over(Window.partitionBy(*[f"t.{k}" for k in key]).orderBy("d.n_chars"))
    times = F.expr("t.copies div t.rows") + (F.col("_i") <= F.expr("t.copies % t.rows")).cast("long")
    repeated = joined.withColumn("_i", number).withColumn("_n", times).where("_n > 0")
    return repeated.withColumn("_j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of token sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("minhash near-dedup", distinct_documents),
    ("mixing to target weights", mixed),
    ("packing", packed),
]

#: Fitting, fuzzy components, seeded draws and tokenizing are not SQL; a brute-force test stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is kept as Parquet for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
