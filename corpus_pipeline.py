"""The corpus pipeline: documents in, packed training sequences out, as stages that hand on Parquet tables.

Every stage but the last returns the columns of documents. Each is one of the numbered operators, applied to all rows it gets.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulmark.llm.common import shared_dir, table
from haulmark.llm.decontamination import clean_documents
from haulmark.llm.minhash_dedup import minhash_dedup
from haulmark.llm.packing import best_fit_packing
from haulmark.llm.quality_rules import quality_filter
from haulmark.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go, and so do null and empty texts. Repeated rows stay or go together."""
    return quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the least doc_id. Of rows with equal doc_id (or none) and equal
    text one stays. Rows without a doc_id are otherwise linked with nothing, so they stay, and so do empty texts."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # names that clash with none of ours
    key, text = (F.col(f"c{names.index(c)}") for c in ("doc_id", "text"))
    gone = minhash_dedup(docs.select("doc_id", "text")).filter("not kept").select(F.col("doc_id").alias("g")).distinct()
    again = plain.groupBy(key.alias("r")).count().filter("count > 1").select("r")
    same = key.eqNullSafe(F.col("r"))
    left = plain.join(gone, key == F.col("g"), "left_anti")
    # few rows have a doc_id that others have: only these are grouped
    one = left.join(again, same, "left_semi").groupBy(key.alias("k"), F.sha2(text.cast("binary"), 256).alias("s")).agg(F.any_value(F.struct(*plain.columns)).alias("row")).select("row.*")
    return left.join(again, same, "left_anti").unionByName(one).toDF(*names)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller doc_id has go; so do documents of which nothing is left.

    n_chars is counted anew. Texts that nothing goes from stay as they are; null and empty ones stay. A missing doc_id counts as larger
    than all others.
    """
    names = docs.columns
    others = [c for c in names if c not in ("doc_id", "text", "n_chars")]
    plain = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    found = substring_dedup(plain, texts=True, carry=tuple(f"c{i}" for i in range(len(others)))).filter("n_removed = 0 or n_removed < n_words")
    chars = [F.char_length("kept_text").cast("long").alias("n_chars")] if "n_chars" in names else []
    out = found.select("doc_id", F.col("kept_text").alias("text"), *chars, *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)])
    return out.select(*[F.col(f"`{c}`") for c in names])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each row by itself; rows without text or id are judged like any other."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their place in a training sequence: a sequence is its pieces' ids by offset. Null and empty texts
    are the end token alone; repeated rows are packed each."""
    return best_fit_packing(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("minhash_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", decontamination),
    ("best_fit_packing", packing),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each one's rows written and read again. An empty table gives an empty result; columns of documents may
    have any names, and repeated rows and missing ids are treated as each stage says."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
