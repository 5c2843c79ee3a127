"""A corpus pipeline of five stages; every stage works on what the one before it kept.

Each stage function takes ``(spark, docs, sf_dir)``. The first four return rows of ``documents``;
the last returns the mix: every document that is left with how often it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftpanel.llm import decontaminate, language, mixing, simhash_wide, substrings
from driftpanel.llm.tables import cut_lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that is more likely than not, go."""
    return language.identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (SimHash, five-word shingles, similarity of 0.8 or more) the smallest id stays."""
    return simhash_wide.first_of_each_group(docs, shingle=5, similarity=0.8)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document with a smaller id has too are cut out."""
    return substrings.kept_texts(docs, window=50)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap an item of ``benchmark`` go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often each document is taken so that sources meet their target weights."""
    return mixing.mix(docs)


STAGES = [
    ("language ID", identify_language),
    ("SimHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: SQL cannot express the language model and the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
