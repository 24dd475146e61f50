"""Mixing sources to target weights: random order within each source, prefix sums of words, a cut at each exact budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import WORD, join_counted, prefix_sums, read, text_of
from plumbline.plans.durable import cut_lineage

#: Weights of the sources in order, and how many times a source may be read.
WEIGHTS = (5, 2, 1)
EPOCHS = 3


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def random_key(id: str) -> Column:
    """A key that looks random and is the same in every run."""
    return F.md5(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Sources (source, source_size, ...) with their weight and target.

    Sources in code point order, null last, take the weights in turn. The sum of all sizes is shared out by weight; a target
    above ``epochs`` times its source's size stops there, and what is left over is shared out again among the rest until none
    is above. That is one level (words for each unit of weight) below which all caps bind: each round takes one row of sums,
    so however many sources there are, they stay distributed. Sources without words have target 0.
    """
    ordered = sources.withColumn("__last", F.col("source").isNull()).withColumn("__one", F.lit(1).cast("long"))
    ranked = prefix_sums(ordered, ["__last", "source"], "__one", "__rank").drop("__last", "__one")
    turn = F.pmod(F.col("__rank"), F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (turn + 1).cast("int")).cast("long")
    weighed = cut_lineage(ranked.withColumn("weight", weight).withColumn("__cap", F.col("source_size") * epochs).drop("__rank"))
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level = -1.0
    while True:
        capped = F.col("__cap") <= F.lit(level) * F.col("weight")
        spent, open_weight = weighed.agg(F.sum(F.when(capped, F.col("__cap"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not open_weight:
            break
        higher = (total - (spent or 0)) / open_weight
        if higher <= level:
            break
        level = higher
    target = F.when(F.col("__cap") <= F.lit(level) * F.col("weight"), F.col("__cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select(*sources.columns, target.alias("target"))


def mix(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(id, source, size, source_size, target, taken): how many words of each document the mix takes.

    Documents of a source stand in the order of a hash of their identifiers. The source's budget (its target, rounded) goes
    over that order as often as it lasts: whole epochs first, then up to the exact word, so that the document at the cut is
    taken in part. No document is taken more than three times.

    Null and empty texts have size 0 and nothing is taken of them; a null source is a source of its own, the last. Repeated
    rows are documents of their own. An empty table gives no rows. Other columns are not touched.
    """
    sized = documents.select(F.col(id).alias("__id"), F.col(source).alias("source"), word_count(text).alias("size"))
    keyed = sized.withColumns({"__last": F.col("source").isNull(), "__key": random_key("__id")})
    placed = cut_lineage(prefix_sums(keyed, ["__last", "source", "__key", "__id", "size"], "size", "__before"))
    sources = placed.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__rows"), F.min("__before").alias("__start")
    )
    targets = cut_lineage(source_targets(sources, weights).withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    total = placed.count()
    rows = placed.select("__id", "source", "size", "__before").withColumn("__name", F.col("source"))
    rows = rows.withColumn("source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    joined = join_counted(rows, targets, ["source"], "__rows", total)
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = budget - epochs * F.col("source_size") - (F.col("__before") - F.col("__start"))
    part = F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return joined.select(
        F.col("__id").alias(id), F.col("__name").alias("source"), "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken")
    )


def mixed_documents(documents: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents that the mix takes, a row for each time; the one at a source's cut is kept whole.

    A document of which no word is taken does not come; identifiers should be unique, since rows with one identifier share
    the number of times of the first.
    """
    taken = mix(documents.select(id, text, source), id, text, source).filter("taken > 0")
    times = taken.groupBy(F.col(id).alias("__id")).agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias("__times"))
    joined = documents.join(times, F.col(id).eqNullSafe(F.col("__id")))
    return joined.withColumn("__time", F.explode(F.sequence(F.lit(1), "__times"))).select(*documents.columns)


def op8_mix_sources(spark: SparkSession, path: str) -> DataFrame:
    """How many words of each document a mix of all sources takes; see :func:`mix`."""
    return mix(read(spark, path, "documents").select("doc_id", "text", "source")).drop("source")


OP8_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::BIGINT AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place, (sum(source_size) OVER ())::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER before, 0)::BIGINT AS spent,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open_weight
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min((total - spent)::DOUBLE / open_weight, place) FILTER (WHERE (total - spent)::DOUBLE / open_weight * weight <= cap) AS level FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN cap <= level * weight THEN cap::DOUBLE ELSE level * weight END AS target FROM filled, level),
placed AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM placed
"""
