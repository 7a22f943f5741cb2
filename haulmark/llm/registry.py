"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from haulmark.llm.chat_formatting import format_conversations, read_back
from haulmark.llm.common import shared_dir, table
from haulmark.llm.decontamination import benchmark_overlap
from haulmark.llm.html_extraction import html_extraction
from haulmark.llm.minhash_dedup import minhash_dedup
from haulmark.llm.packing import best_fit_packing
from haulmark.llm.pii import personal_data
from haulmark.llm.quality_rules import ORACLE as QUALITY_SQL
from haulmark.llm.quality_rules import quality_rules
from haulmark.llm.sharding import sharding
from haulmark.llm.spelling_variants import spelling_variants
from haulmark.llm.substring_dedup import substring_dedup
from haulmark.llm.suffix_array_dedup import suffix_array_dedup
from haulmark.llm.token_counts import token_counts
from haulmark.llm.whitening import embedding_whitening


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_overlap(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("n_lines", "rejected_by")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction(table(spark, sf_dir, "pages"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(conversations.unionByName(control)))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding(table(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_whitening(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_sharding": op10_sharding,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_personal_data": op12_personal_data,
    "op13_embedding_whitening": op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": QUALITY_SQL,
}
