"""Queries of the training-data operators, with the SQL that can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehealth.llm import bpe_tree, byte_dedup, encode, jaccard, licences, mixing, packing, periodic, quality, substring_dedup, token_files, topk, toxicity, whitening
from tablehealth.llm.common import documents


def op1_token_files(spark, sf_dir):
    """Every document's place, length and checksum, read back from packed token files."""
    return token_files.write_and_read(documents(spark, sf_dir), encode.vocabulary_path("word_bpe_49k.json"))


def op2_quality_rules(spark, sf_dir):
    """Base rules and host verdicts of every document."""
    return quality.judge(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_source_mix(spark, sf_dir):
    """Size, target and taken words of every document."""
    return mixing.taken(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_top_k(spark, sf_dir):
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) e FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
     s AS (SELECT q.vec_id query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) score
           FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
     r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_byte_dedup(spark, sf_dir):
    """Bytes of every document that lie in a repeated 200-byte string."""
    return byte_dedup.digest(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_substring_dedup(spark, sf_dir):
    """Words of every document that a smaller doc_id holds in a run of 50."""
    return substring_dedup.digest(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_jaccard_join(spark, sf_dir):
    """Set size and component of every document at Jaccard 0.75 on 5-word shingles."""
    return jaccard.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    return toxicity.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_licence_scan(spark, sf_dir):
    """Known licence sentences and licences of every document."""
    return licences.scan(documents(spark, sf_dir))


def op9_best_fit_packing(spark, sf_dir):
    """Every piece of every document with its sequence and offset."""
    return packing.pack_documents(documents(spark, sf_dir), encode.vocabulary_path("byte_bpe_50k.json"))


def op11_embedding_whitening(spark, sf_dir):
    """Deviation, whitened coordinates and explained variance of every vector, for eight components."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of every document, a tenth of them with planted endings, and the text without repeats."""
    return periodic.digest(periodic.collapse(periodic.planted(documents(spark, sf_dir))))


def op13_bpe_round_trip(spark, sf_dir):
    """Ids of every document and the text they decode to, as checksums."""
    path = encode.vocabulary_path("word_bpe_49k.json")
    decoded = bpe_tree.decode(bpe_tree.encode_documents(documents(spark, sf_dir), path), path)
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def queries():
    return {
        "op1_token_files": op1_token_files,
        "op2_quality_rules": op2_quality_rules,
        "op3_source_mix": op3_source_mix,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_byte_dedup": op5_byte_dedup,
        "op6_toxicity": op6_toxicity,
        "op7_jaccard_join": op7_jaccard_join,
        "op8_licence_scan": op8_licence_scan,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_bpe_round_trip": op13_bpe_round_trip,
    }


def oracle_sql():
    return {
        "op4_exact_top_k": OP4_SQL,
        "op8_licence_scan": licences.duckdb_sql(),
    }
