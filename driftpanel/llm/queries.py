"""The registered queries over text corpora, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from driftpanel.llm import collocations, conversations, cotraining, decontaminate, html_text, language, link_graph, mixing, quality_rules, simhash, sql, substrings, token_store, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return cotraining.scored(docs, cotraining.fit(docs, _table(spark, sf_dir, "labels")))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_table(spark, sf_dir, "documents"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_rules.judged(docs, quality_rules.learn_rules(docs, _table(spark, sf_dir, "labels")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_graph.judged(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digests(_table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_substrings": op4_substrings,
    "op5_tokens": op5_tokens,
    "op6_language": op6_language,
    "op7_html": op7_html,
    "op8_simhash": op8_simhash,
    "op9_rules": op9_rules,
    "op10_urls": op10_urls,
    "op11_collocations": op11_collocations,
    "op12_token_store": op12_token_store,
    "op13_conversations": op13_conversations,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = sql.ORACLES
