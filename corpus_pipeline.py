"""Documents from raw to token ids in five stages, each written and read again by the next.

Rows without a text, repeated rows, empty tables and further columns pass through as the
operators' docstrings say; a stage returns the columns it was given, and the last one ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hustings.llm import bpe, decontaminate, near_dedup, quality_rules, substring
from hustings.llm.shared import free_name
from hustings.session import stage_path

POLICY = 2  # of the quality rules
SHINGLE, SIMILAR = 5, 80  # words of a shingle; percent of the union that near duplicates share


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality_rules.accepted(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one_per_group(docs, SHINGLE, SIMILAR)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that an earlier one has; ``n_chars`` follows the text."""
    removed = free_name(docs, "_removed")
    cut = substring.remove_repeats(docs, removed=removed)
    if "n_chars" in docs.columns:
        length = F.when(F.size(removed) > 0, F.length("text")).otherwise(F.col("n_chars"))
        cut = cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, ids, decoded, n_tokens`` of every document."""
    return bpe.encode_texts(docs, bpe.default_vocabulary()).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", passages),
    ("decontamination", benchmark_free),
    ("bpe", token_ids),
]
# Similarity of full sets, units picked by content and merges by rank are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = stage_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
