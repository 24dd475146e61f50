"""Hard negatives by secondary sort: pair scores travel in order of (anchor, falling score, id) and one pass opens and fills windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import read
from plumbline.plans.durable import cut_lineage

#: Positives of an anchor, negatives of a positive, and the least and greatest share (in hundredths) of the positive's score.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
SCALE = 256
#: Anchors are compared in batches whose vectors fill so many bytes: what is sent to each task.
BATCH_BYTES = 1 << 25
#: Rows multiplied at a time, as scores of all anchors of a batch in one task's memory.
SCORES = 1 << 20
EXACT_DOUBLE, EXACT_LONG = 2**53, 2**63


def quantised(vector: str) -> Column:
    """floor(256 * x) of each component, x as double; null where a component is null or not finite, or a score may not fit 64 bits."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = F.transform(x, lambda v: F.floor(v * F.lit(float(SCALE))).cast("double"))
    largest = F.coalesce(F.array_max(F.transform(scaled, lambda v: F.abs(v))), F.lit(0.0))
    fits = largest * largest * F.size(x) < float(EXACT_LONG)
    return F.when(finite & fits, F.transform(F.when(finite & fits, scaled), lambda v: v.cast("long")))


def prepared(rows: DataFrame, is_anchor: Column, id: str, vector: str, label: Column) -> DataFrame:
    """(row, id, label, vector, is_anchor) of the rows that take part, written once."""
    own = rows.select(F.col(id).cast("long").alias("id"), label.alias("label"), quantised(vector).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    usable = own.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL")
    return cut_lineage(usable.withColumn("row", F.monotonically_increasing_id()).withColumn("label", F.col("label").cast("string")))


class Anchors:
    """The anchors of one batch with vectors of one length, and the windows that their positives open."""

    def __init__(self, rows: list, windows: dict[int, list[tuple[int, int]]] | None = None):
        self.rows = np.array([r["row"] for r in rows], np.int64)
        self.names: dict[str, int] = {}
        self.labels = np.array([self.names.setdefault(r["label"], len(self.names)) for r in rows], np.int64)
        self.vectors = np.array([list(r["vector"]) for r in rows], np.int64).reshape(len(rows), len(rows[0]["vector"]))
        self.low = np.full((POSITIVES, len(rows)), 1, np.int64)
        self.high = np.zeros((POSITIVES, len(rows)), np.int64)
        for i, row in enumerate(self.rows.tolist() if windows else []):
            for k, (low, high) in enumerate(windows.get(row, [])):
                self.low[k, i], self.high[k, i] = low, high

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        """Exact inner products: doubles hold them where no sum can pass 2^53, else whole numbers do."""
        largest = [int(np.abs(v).max(initial=0)) for v in (vectors, self.vectors)]
        if largest[0] * largest[1] * vectors.shape[1] < EXACT_DOUBLE:
            return (vectors.astype(np.float64) @ self.vectors.T.astype(np.float64)).astype(np.int64)
        return vectors @ self.vectors.T


class Best:
    """The first ``keep`` scores of every column, as (column, score, id, row) in order of falling score and rising id."""

    def __init__(self, columns: int, keep: int):
        self.keep, self.found = keep, [np.empty(0, np.int64)] * 4
        self.least = np.full(columns, np.iinfo(np.int64).min)  # below it nothing can be among the first

    def add(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        least = self.least
        if len(scores) > self.keep:
            known = np.partition(np.where(allowed, scores, np.iinfo(np.int64).min), len(scores) - self.keep, axis=0)
            least = np.maximum(least, known[len(scores) - self.keep])
        at, column = np.nonzero(allowed & (scores >= least))
        if not len(at):
            return
        found = [np.concatenate(pair) for pair in zip(self.found, (column, scores[at, column], ids[at], rows[at]))]
        order = np.lexsort((found[3], found[2], -found[1], found[0]))
        column = found[0][order]
        rank = np.arange(len(order)) - np.searchsorted(column, column)
        self.found = [f[order[rank < self.keep]] for f in found]
        full = rank[rank < self.keep] == self.keep - 1
        self.least[self.found[0][full]] = self.found[1][full]


def compared(groups: dict[int, Anchors], positives: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each task's own best pairs: an anchor's first rows of its label, or the first of other labels in each of its windows. No
    other row of the task can be among the first of all, so nothing is lost by leaving them where they are."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], Best] = {}
        for batch in batches:
            for size, same in batch.groupby(batch["vector"].map(len), sort=True):
                anchors = groups.get(size)
                if anchors is None:
                    continue
                step = max(SCORES // len(anchors.rows), 1)
                for at in range(0, len(same), step):
                    part = same.iloc[at : at + step]
                    ids, rows = part["id"].to_numpy(np.int64), part["row"].to_numpy(np.int64)
                    scores = anchors.scores(np.stack([np.asarray(v, np.int64) for v in part["vector"]]).reshape(len(part), size))
                    labels = np.array([anchors.names.get(name, -1) for name in part["label"]], np.int64)
                    alike = labels[:, None] == anchors.labels[None, :]
                    if positives:
                        alike &= rows[:, None] != anchors.rows[None, :]
                        best.setdefault((size, 0), Best(len(anchors.rows), POSITIVES)).add(scores, alike, ids, rows)
                    else:
                        for k in range(POSITIVES):
                            inside = ~alike & (scores >= anchors.low[k]) & (scores <= anchors.high[k])
                            best.setdefault((size, k), Best(len(anchors.rows), NEGATIVES)).add(scores, inside, ids, rows)
        for size, anchors in groups.items():
            kept = [b.found for (own, _), b in best.items() if own == size]
            if kept:
                column, score, id, row = np.unique(np.concatenate([np.stack(k) for k in kept], axis=1), axis=1)
                yield pd.DataFrame({"anchor": anchors.rows[column], "score": score, "id": id, "row": row})

    return work


def in_order(pairs: DataFrame) -> DataFrame:
    """Pairs dealt out by anchor and sorted inside each task: the shuffle sorts by (anchor, falling score, positives first, id).

    A positive comes before the negatives of its score, so its window is open when they pass.
    """
    return pairs.repartition("anchor").sortWithinPartitions("anchor", F.desc("score"), "kind", "id", "row")


def first_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first positives of each anchor, in a stream of ordered pairs."""
    anchor, seen = None, 0
    for batch in batches:
        keep = []
        for own in batch["anchor"]:
            anchor, seen = (anchor, seen + 1) if own == anchor else (own, 1)
            keep.append(seen <= POSITIVES)
        yield batch[np.array(keep, bool)]


def window(score: int) -> tuple[int, int]:
    """The least and greatest score of negatives for a positive of this score; empty where the first is above the second."""
    return -((-LEAST * score) // 100), (MOST * score) // 100


def mined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(anchor, positive, rank, negative, scores) from a stream of ordered pairs: positives open windows, negatives fill them.

    All that is kept of an anchor are its open windows, each with its number of negatives so far.
    """
    anchor, opened = None, []
    for batch in batches:
        rows = []
        for own, score, kind, id in zip(batch["anchor"].tolist(), batch["score"].tolist(), batch["kind"].tolist(), batch["id"].tolist()):
            if own != anchor:
                anchor, opened = own, []
            if kind == 0:
                opened.append([id, score, *window(score), 0])
                continue
            for place in opened:
                if place[2] <= score <= place[3] and place[4] < NEGATIVES:
                    place[4] += 1
                    rows.append((own, place[0], place[4], id, place[1], score))
        yield pd.DataFrame(rows, columns=["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"], dtype="int64")


def _grouped(rows: list, windows: dict | None = None) -> dict[int, Anchors]:
    sizes: dict[int, list] = {}
    for row in rows:
        sizes.setdefault(len(row["vector"]), []).append(row)
    return {size: Anchors(same, windows) for size, same in sizes.items()}


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "embedding", label: Column | str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors.

    Components become whole numbers (floor of 256 times each), a score is the inner product of two rows of vectors of one length.
    An anchor's positives are its first five other rows of its label, by falling score and rising id; a positive's negatives are
    the first ten rows of other labels whose score is from 30 to 90 hundredths of the positive's. An anchor without such rows has
    none in the result.

    Anchors are a stated set of queries against all rows: they are taken in batches of bounded size, and each batch meets the
    rows where they lie. A task keeps, of each anchor, the few of its own rows that can be among the first; those are sorted
    by anchor and falling score in one shuffle and read in a stream. This happens twice, since windows depend on positives.

    Rows with a null id, label or vector, with a null or non-finite component, or with components so large that a product
    might not fit 64 bits take no part. Repeated rows are rows of their own, also as each other's positives; so is each anchor
    of a repeated id. Empty vectors score 0 with each other. Without rows or anchors the result is empty. Only the named columns
    are read, so other names cannot clash.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    usable = prepared(rows, is_anchor, id, vector, label)
    anchors = usable.filter("is_anchor")
    size = anchors.agg(F.sum(F.size("vector") * 8 + 64)).first()[0] or 0
    batches = -(-size // BATCH_BYTES)
    dealt = anchors.withColumn("batch", F.pmod(F.xxhash64("row"), F.lit(max(batches, 1))))
    pair = "anchor long, score long, id long, row long"
    found = []
    for batch in range(batches):
        own = dealt.filter(F.col("batch") == batch).select("row", "label", "vector").collect()
        if not own:
            continue
        near = usable.mapInPandas(compared(_grouped(own), True), pair).withColumn("kind", F.lit(0))
        positives = cut_lineage(in_order(near).mapInPandas(first_positives, f"{pair}, kind int"))
        windows: dict[int, list[tuple[int, int]]] = {}
        for r in positives.select("anchor", "score").collect():  # five of each anchor of the batch
            windows.setdefault(r["anchor"], []).append(window(r["score"]))
        far = usable.mapInPandas(compared(_grouped(own, windows), False), pair).withColumn("kind", F.lit(1))
        found.append(in_order(positives.unionByName(far)).mapInPandas(mined, "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"))
    empty = spark.createDataFrame([], "anchor long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    names = anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
    return reduce(DataFrame.unionByName, found, empty).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    """Hard negatives for every hundredth vector; see :func:`hard_negatives`."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, path, "embeddings"), F.col("vec_id") % 100 == 0, label=shifted)


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_sum(list_transform(embedding, lambda e: (e IS NULL OR NOT isfinite(e))::INT)), 0) = 0),
scored AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id,
  positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT alike AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
QUALIFY rank <= {NEGATIVES}
"""
