"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe import digests, tokenizer_path
from plumbline.llm.common import bucket, read
from plumbline.llm.exact import drop_exact_duplicates
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.nearcopies import drop_near_copies
from plumbline.llm.toxicity import reject_toxic
from plumbline.plans.durable import scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: The first stage learns from labels, which SQL cannot express; the stages are tested against brute force instead.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return reject_toxic(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic").filter(bucket("doc_id", 5) != 0))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with one text, the one with the smallest doc_id stays."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents come as often as the mix takes them."""
    return mixed_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's number of tokens, with digests of its ids and of its decoded text."""
    return digests(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("bpe", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents below ``sf_dir``; each result is written to the shared folder and read from there."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
