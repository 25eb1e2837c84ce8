"""Corpus pipeline: quality rules, near-dedup, repeated passages, benchmark
leaks, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, written
as Parquet in the shared folder and read again as the next stage's ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, minhash, quality, repeats
from tidemark.session import cut_lineage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the count rules and the compression bands."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the smallest id."""
    return minhash.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that also stand earlier are cut out of the texts; ``n_chars``
    follows."""
    cut = repeats.cut_texts(docs)
    if "n_chars" in cut.columns:
        kind = cut.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))
    return cut


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return byte_bpe.digests(docs, *byte_bpe.default_ranks())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("encode_tokens", encode_tokens),
]

# Compression, sketches and tokens have no SQL form; tests/llm checks run()
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
