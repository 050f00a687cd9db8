"""One registered query for each operator, over whole tables, and the pipeline's run."""

from __future__ import annotations

from odolake.llm import brown, divergence, embeddings, fingerprints, lines, middles, minhash, mixing, packing, quality, secrets_scan, shards, toxicity
from odolake.llm.common import table
from odolake.llm.sql import SQL  # noqa: F401  (offered with the queries)

TOKENIZER = "word_bpe_49k.json"


def op1_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_minhash_near_dedup(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark, sf_dir):
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op5_quality_classifier(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark, sf_dir):
    return embeddings.near_embeddings(table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark, sf_dir):
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op8_secret_scans(spark, sf_dir):
    return secrets_scan.scan_secrets(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    return brown.score_texts(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "text_hash")


def op11_fill_in_middle(spark, sf_dir):
    return middles.digests(middles.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark, sf_dir):
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_sharding(spark, sf_dir):
    return shards.shard_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_packing": op4_packing,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_secret_scans": op8_secret_scans,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_mixing": op10_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_source_divergence": op12_source_divergence,
    "op13_sharding": op13_sharding,
}

