"""Embedding near-duplicates: binary codes of randomly rotated vectors find pairs and estimate them; close ones are recomputed."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import components, join_counted, read
from plumbline.plans.durable import cut_lineage

THRESHOLD = 0.93
#: A pair is compared when it agrees on all bits of a band. At the threshold a bit agrees with 0.88, so 80 bands of 16 bits miss
#: a pair in 70,000; unrelated vectors meet in a band once in 65,536.
BANDS, BAND_BITS = 80, 16
#: Rotations whose codes estimate a pair, and standard errors by which an estimate may fall short before a pair is given up.
ESTIMATING, SIGMAS = 4, 5.0
SEED = 20
#: Vectors of a bucket that one task compares with each other; larger buckets are cut into blocks.
BLOCK = 2_000


@lru_cache(maxsize=8)
def rotations(size: int) -> np.ndarray:
    """Random orthogonal matrices of this size, as many as the bands need bits."""
    made = np.random.default_rng(SEED + size)
    many = max(ESTIMATING, -(-BANDS * BAND_BITS // size))
    return np.stack([np.linalg.qr(made.standard_normal((size, size)))[0] for _ in range(many)])


def scaled(vectors: list) -> np.ndarray:
    """Rows divided by a power of two near their largest component, so no square gets lost or overflows and no bit changes."""
    x = np.array([np.asarray(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(vectors: list) -> np.ndarray:
    """Rows of length one."""
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotated(x: np.ndarray, many: int | None = None) -> np.ndarray:
    """Vectors by rotation by component."""
    return np.einsum("nd,rde->nre", x, rotations(x.shape[1])[:many], optimize=True)


def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each vector its buckets, and for the estimating rotations the code (signs) and its correction factor: the inner
    product of the vector with its own code."""
    for batch in batches:
        for size, same in batch.groupby(batch["vector"].map(len), sort=True):
            for at in range(0, len(same), 1024):
                part = same.iloc[at : at + 1024]
                turned = rotated(unit(list(part["vector"])))
                bits = (turned > 0).reshape(len(part), -1)
                words = bits[:, : BANDS * BAND_BITS].reshape(len(part), BANDS, BAND_BITS) @ (1 << np.arange(BAND_BITS, dtype=np.int64))
                keys = (np.arange(BANDS, dtype=np.int64) << 32) | words
                some = turned[:, :ESTIMATING]
                factors = np.abs(some).sum(axis=2) / np.sqrt(size)
                codes = np.packbits(bits[:, : ESTIMATING * size], axis=1)
                yield part[["class", "label"]].assign(size=size, buckets=list(keys), code=[c.tobytes() for c in codes], factors=list(factors))


def estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose cosine may reach the threshold: the code of ``b`` against the vector of ``a`` gives an unbiased estimate (inner
    product over correction factor), with an error that shrinks with the root of all bits."""
    for batch in batches:
        for size, same in batch.groupby(batch["vector"].map(len), sort=True):
            for at in range(0, len(same), 1024):
                part = same.iloc[at : at + 1024]
                turned = rotated(unit(list(part["vector"])), ESTIMATING)
                bits = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in part["code"]]), axis=1)[:, : ESTIMATING * size]
                signs = (bits.reshape(turned.shape) * 2.0 - 1) / np.sqrt(size)
                factors = np.stack(list(part["factors"]))
                estimates = ((signs * turned).sum(axis=2) / factors).mean(axis=1)
                variance = ((1 - factors**2).clip(0) / factors**2).mean(axis=1) / max(size - 1, 1) / ESTIMATING
                yield part[estimates + SIGMAS * np.sqrt(variance) + 1e-9 >= THRESHOLD][["a", "b", "vector"]]


def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The pairs whose cosine, in double precision, reaches the threshold."""
    for batch in batches:
        for _, same in batch.groupby(batch["vector"].map(len), sort=True):
            for at in range(0, len(same), 1024):
                part = same.iloc[at : at + 1024]
                x, y = (scaled(list(part[c])) for c in ("vector", "other"))
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield part[cosine >= THRESHOLD][["a", "b"]]


def pairs_of_buckets(placed: DataFrame) -> DataFrame:
    """The pairs (a < b) of classes that share a bucket, each once; ``placed`` is (class, label, size, bucket).

    A bucket of more than BLOCK classes is cut into blocks, and each two blocks are one key, so a crowded bucket is compared by
    many tasks. Classes alone in their bucket go no further.
    """
    keys = ["label", "size", "bucket"]
    placed = cut_lineage(placed)
    buckets = cut_lineage(placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    total = buckets.agg(F.sum("members")).first()[0] or 0
    together = join_counted(placed, buckets, keys, "members", total).filter("members IS NOT NULL")
    blocks = F.ceil(F.col("members") / BLOCK)
    own = together.withColumn("block", F.pmod(F.xxhash64("class"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = own.select(*keys, "class", "block", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"))
    a = dealt.withColumnsRenamed({"class": "a", "block": "block_a"})
    b = dealt.withColumnsRenamed({"class": "b", "block": "block_b"})
    apart = (F.col("low") == F.col("high")) | (F.col("block_a") != F.col("block_b"))
    return a.join(b, [*keys, "low", "high"]).filter((F.col("a") < F.col("b")) & apart).select("a", "b").distinct()


def near_vectors(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) of each row: how many other vectors it is linked with, and the group it is in.

    Vectors of one label (not null) and one length are linked from cosine 0.93. Null and empty vectors, zero vectors, vectors
    with a null or non-finite component, and rows without identifier are linked with nothing. Equal vectors of a label form a
    class, which is compared once and counts with all its rows, so thousands of copies make no pairs among themselves. Rows
    are matched to classes by 128 bits of their contents, and classes have numbers of their own, so rows with one identifier and
    different contents stay apart. Repeated rows are vectors of their own; there is a row for each row of the input, and an empty
    table gives none. Only the three named columns are read, so other names cannot clash.
    """
    number = F.col("vector")
    rows = embeddings.select(F.col(id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall(number, finite) & F.exists(number, lambda x: x != 0)
    keyed = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.md5(F.concat_ws("|", F.col("label").cast("string"), number.cast("string")))))
    grouped = keyed.filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    classes = cut_lineage(grouped.withColumn("class", F.monotonically_increasing_id()))
    kind = classes.schema["label"].dataType.simpleString()
    coded = cut_lineage(classes.select("class", "label", "vector").mapInPandas(encode, f"class long, label {kind}, size int, buckets array<bigint>, code binary, factors array<double>"))
    placed = coded.select("class", "label", "size", F.explode("buckets").alias("bucket"))
    pairs = pairs_of_buckets(placed)
    vectors = classes.select("class", "vector")
    first = pairs.join(vectors.withColumnRenamed("class", "a"), "a").join(coded.select(F.col("class").alias("b"), "code", "factors"), "b")
    likely = first.mapInPandas(estimate, "a long, b long, vector array<double>")
    both = likely.join(vectors.select(F.col("class").alias("b"), F.col("vector").alias("other")), "b")
    links = cut_lineage(both.mapInPandas(confirm, "a long, b long"))
    sizes = classes.select("class", "n")
    ways = links.union(links.select("b", "a"))
    beside = ways.join(sizes.withColumnRenamed("class", "b"), "b").groupBy("a").agg(F.sum("n").alias("beside"))
    linked = components(classes.select(F.col("class").alias("node")), links)
    known = classes.select("key", "class", "n", "least").join(beside, F.col("class") == F.col("a"), "left").join(linked, F.col("class") == F.col("node"))
    known = cut_lineage(known.select("key", "n", "least", (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"), "component"))
    lowest = cut_lineage(known.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    named = join_counted(known, lowest, ["component"], "classes", lowest.agg(F.sum("classes")).first()[0] or 0)
    table = cut_lineage(named.select("key", "n", "n_links", F.coalesce("smallest", "least").alias("component")))
    total = table.agg(F.sum("n")).first()[0] or 0
    # rows without a key never meet a class, and are spread by their own contents
    asked = keyed.select("id", F.coalesce("key", F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).alias("key"))
    found = join_counted(asked, table, ["key"], "n", total)
    component = F.coalesce("component", "id")
    return found.select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op5_near_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Links and groups of all vectors; see :func:`near_vectors`."""
    return near_vectors(read(spark, path, "embeddings").select("vec_id", "embedding", "label"))


OP5_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum([(e IS NULL OR NOT isfinite(e))::INT for e in embedding::DOUBLE[]]) = 0
    AND list_sum([e * e for e in embedding::DOUBLE[]]) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.x) = len(q.x)
  WHERE list_cosine_similarity(p.x, q.x) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
numbers AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN lowest ON lowest.a = e.vec_id LEFT JOIN numbers ON numbers.a = e.vec_id
"""
