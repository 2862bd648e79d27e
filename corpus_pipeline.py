"""The corpus pipeline: language ID, exact dedup, n-gram Jaccard join, mixing
to target weights, byte-level BPE.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage
before kept; its result is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tunelake.llm import bpe, dedup, jaccard, langid, mixing
from tunelake.session import scratch_path

#: Near copies share four fifths of their five-word shingles; op5's own 3 words and 0.9 are its digest's.
NEAR_WIDTH = 5
NEAR_THRESHOLD = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; texts without a letter go."""
    return langid.keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id."""
    return jaccard.one_per_component(docs, width=NEAR_WIDTH, threshold=NEAR_THRESHOLD)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes, per document taken."""
    return bpe.digests(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_jaccard", near), ("mix_sources", mixture),
          ("byte_bpe", tokens)]

#: Compression, components and BPE have no SQL: tests/llm/test_text_models.py compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
