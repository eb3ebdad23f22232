"""The corpus pipeline: documents through filters, deduplication, mixing and packing.

Every stage's rows are written as Parquet and read back as the next stage's documents.

In every stage nulls count as empty texts, or as a source or id of their own, the last;
rows that repeat share what becomes of them, and of exact copies the near-duplicate stage
keeps one; ties go to the smaller doc_id; an empty table gives an empty one; very long
texts are taken whole; columns may have any names and come through unchanged, but for text
and n_chars where a stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablehealth.llm import common, encode, jaccard, mixing, packing, quality, substring_dedup


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose host is rejected; null and empty texts fail, a null host is never rejected."""
    return quality.keep(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of near duplicates; texts without words are no one's duplicate, a null doc_id comes last."""
    return jaccard.keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages of 50 words and more out that a smaller doc_id holds; documents that held nothing else go."""
    return substring_dedup.remove(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, cuts or leaves out documents so that sources meet their target shares; those without words go."""
    return mixing.repeat(docs)


def best_fit(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences of at most 1024 tokens: one row per piece; a text without tokens is its end id alone."""
    return packing.pack_documents(docs, encode.vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substrings),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit),
]

#: Hashing, prefix filters and packing are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents`` and returns the last one's rows; what the others wrote is deleted at the end."""
    docs = common.documents(spark, sf_dir)
    with common.scratch(spark):
        for name, function in STAGES:
            docs = common.stage(function(spark, docs, sf_dir), name, keep=(name, function) == STAGES[-1])
    return docs
