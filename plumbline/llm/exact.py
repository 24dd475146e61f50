"""Exact duplicates: rows grouped by a 128-bit hash of their text, texts compared inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import SPACES, join_counted, read, text_of
from plumbline.plans.durable import cut_lineage


def normalised(column: str) -> Column:
    """The text with each run of white space as one space; null counts as empty."""
    return F.regexp_replace(text_of(column), SPACES, " ")


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 form."""
    return F.md5(text.cast("binary"))


def exact_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text", hash: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row for each row of ``documents``: its columns but the text, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the hash of their normalised text. In each group the least and greatest text are taken: if they are
    equal, byte for byte, the group is one text; a group where they differ (a collision) is divided by the texts themselves.
    Texts are combined on the map side, so that a text which fills a third of the table is sent once for each task.

    Null and empty texts are one group. The row with the smallest identifier stays; of repeated rows with that identifier all
    say ``kept``, and a null identifier counts as larger than any other. An empty table gives no rows. Other columns of the
    input, whatever their names, are not touched; results that clash with one replace it.
    """
    results = ("keep_id", "group_size", "kept", "text_sha256")
    own = [c for c in documents.columns if c not in (text, *results)]
    norm = normalised(text)
    keyed = documents.select(*own, hash(norm).alias("__hash"), F.sha2(norm, 256).alias("text_sha256"))
    hashed = documents.select(F.col(id).alias("__id"), norm.alias("__norm")).withColumn("__hash", hash(F.col("__norm")))
    groups = cut_lineage(
        hashed.groupBy("__hash").agg(
            F.min("__id").alias("keep_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min("__norm").eqNullSafe(F.max("__norm")).alias("__same"),
        )
    )
    total, collided = groups.agg(F.sum("group_size"), F.count_if(~F.col("__same"))).first()
    out = [*own, "keep_id", "group_size", F.col(id).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    same = groups.filter("group_size > 1 AND __same").select("__hash", "keep_id", "group_size")
    if not collided:
        found = join_counted(keyed, same, ["__hash"], "group_size", total or 0)
        return _singles(found, id).select(*out)
    mixed = groups.filter(~F.col("__same")).select("__hash", F.lit(True).alias("__mixed"), "group_size")
    texts = documents.select(*own, norm.alias("__norm"), F.sha2(norm, 256).alias("text_sha256")).withColumn("__hash", hash(F.col("__norm")))
    marked = join_counted(texts, mixed, ["__hash"], "group_size", total).drop("group_size")
    apart = marked.filter("__mixed")
    by_text = cut_lineage(apart.groupBy("__hash", "__norm").agg(F.min(id).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    divided = join_counted(apart.drop("__mixed"), by_text, ["__hash", "__norm"], "group_size", total).drop("__norm")
    whole = join_counted(marked.filter("__mixed IS NULL").drop("__mixed", "__norm"), same, ["__hash"], "group_size", total)
    return _singles(whole.unionByName(divided), id).select(*out)


def _singles(rows: DataFrame, id: str) -> DataFrame:
    alone = F.col("group_size").isNull()
    return rows.withColumns(
        {"keep_id": F.when(alone, F.col(id)).otherwise(F.col("keep_id")), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))}
    )


def drop_exact_duplicates(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay: of each group of equal texts the row with the smallest identifier."""
    stays = exact_duplicates(documents.select(id, text), id, text).filter("kept").select(id).distinct()
    return documents.join(stays.withColumnRenamed(id, "__kept"), F.col(id).eqNullSafe(F.col("__kept")), "left_semi")


def op2_exact_dedup(spark: SparkSession, path: str) -> DataFrame:
    """Of every document the one that stands for its text; see :func:`exact_duplicates`."""
    return exact_duplicates(read(spark, path, "documents").select("doc_id", "text"))


OP2_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
found AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256
  FROM texts)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM found
"""
