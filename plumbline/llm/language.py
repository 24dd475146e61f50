"""Language identification by string kernels: Nyström landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import bucket, extended, read, share

#: Bounds of the fit: rows of each language in the training sample and among the landmarks (both as expected numbers, drawn by
#: a hash of the row), and n-grams that the kernel knows (those of most landmarks).
SAMPLE_PER_LANGUAGE = 500
LANDMARKS_PER_LANGUAGE = 24
FEATURES = 16_384
RIDGE = 1e-3
ROWS_PER_PRODUCT = 256
PIECE = 1 << 20


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of 1, 2 and 3 characters of the lower-cased text, each packed exactly into 63 bits, sorted.

    Long texts are read in overlapping pieces, so the arrays at work stay small.
    """
    found = np.empty(0, np.int64)
    lowered = text.lower()
    for at in range(0, max(len(lowered), 1), PIECE):
        c = np.frombuffer(lowered[at : at + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 1
        two = (c[:-1] << 21) | c[1:]
        every = np.concatenate([c, two, (two[:-1] << 21) | c[2:]])
        every.sort()
        keep = np.ones(len(every), bool)
        np.not_equal(every[1:], every[:-1], out=keep[1:])
        every = every[keep]
        found = every if not len(found) else np.union1d(found, every)
    return found


@dataclass
class LanguageModel:
    """languages: the classes in order; vocabulary: known n-grams, sorted; presence: one column for each landmark;
    sizes: n-grams of each landmark; weights: from kernel values, and a constant in the last row, to class scores."""

    languages: list[str]
    vocabulary: np.ndarray
    presence: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Shared n-grams of each text and landmark, over the root of both numbers of n-grams, by one matrix product."""
        rows = np.zeros((len(texts), len(self.vocabulary)), np.float32)
        counts = np.ones(len(texts))
        for i, text in enumerate(texts):
            own = grams(text)
            at = np.searchsorted(self.vocabulary, own)
            at[at == len(self.vocabulary)] = 0
            rows[i, at[self.vocabulary[at] == own]] = 1
            counts[i] = max(len(own), 1)
        return (rows @ self.presence).astype(np.float64) / np.sqrt(counts[:, None] * self.sizes[None, :])

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.kernel(texts) @ self.weights[:-1] + self.weights[-1]


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", seed: str = "doc_id") -> LanguageModel | None:
    """Fit on rows with a language and a letter in their text; None if there are none.

    Rows per language are counted over the whole table; then each language's share of rows is drawn by a hash of ``seed``
    and text length. Landmarks are the rows with the smallest hashes of that sample. The regression is solved on the driver:
    it receives the landmarks' n-grams and one row of kernel values for each row of the sample.
    """
    usable = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not counts:
        return None
    spark = labelled.sparkSession
    languages = sorted(counts)
    place = F.create_map(*(F.lit(x) for name in languages for x in (name, languages.index(name))))[F.col(lang)].cast("int")
    wanted = F.create_map(*(F.lit(x) for name in languages for x in (name, SAMPLE_PER_LANGUAGE / counts[name])))[F.col(lang)]
    drawn = usable.select(place.alias("class"), F.col(text).alias("text"), share(seed, F.length(text)).alias("u"), wanted.alias("wanted")).filter("u < wanted")
    marks = drawn.filter(F.col("u") < F.col("wanted") * (LANDMARKS_PER_LANGUAGE / SAMPLE_PER_LANGUAGE))

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"class": batch["class"], "grams": [grams(t) for t in batch["text"]]})

    spelled = marks.select("class", "text").mapInPandas(spell, "class int, grams array<bigint>").withColumn("mark", F.monotonically_increasing_id())
    known = spelled.select(F.explode("grams").alias("gram")).groupBy("gram").count().orderBy(F.desc("count"), "gram").limit(FEATURES)
    vocabulary = np.array(sorted(r[0] for r in known.collect()), np.int64)
    in_use = spark.createDataFrame([(int(g),) for g in vocabulary], "gram bigint")
    sparse = spelled.select("mark", "class", F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(in_use), "gram")
    columns = sparse.groupBy("mark").agg(F.first("class").alias("class"), F.first("n").alias("n"), F.sort_array(F.collect_set("gram")).alias("grams")).collect()
    columns.sort(key=lambda r: (r["class"], r["n"], r["grams"]))
    presence = np.zeros((len(vocabulary), len(columns)), np.float32)
    for j, row in enumerate(columns):
        presence[np.searchsorted(vocabulary, np.array(row["grams"], np.int64)), j] = 1
    sizes = np.array([r["n"] for r in columns], float)
    model = LanguageModel(languages, vocabulary, presence, sizes, np.eye(len(columns)))
    shared = spark.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in pieces(batch, ROWS_PER_PRODUCT):
                yield pd.DataFrame({"class": part["class"], "k": list(shared.value.kernel(list(part["text"])))})

    sample = drawn.select("class", "text").mapInPandas(measure, "class int, k array<double>").collect()
    sample.sort(key=lambda r: (r["class"], r["k"]))
    # Nyström: with landmark kernel C, kernel values k become features k C^(-1/2); ridge regression in that space
    own = (presence.T @ presence).astype(float) / np.sqrt(np.outer(sizes, sizes))
    values, vectors = np.linalg.eigh(own)
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    x = np.array([r["k"] for r in sample]) @ root
    y = np.where(np.arange(len(languages))[None, :] == np.array([r["class"] for r in sample])[:, None], 1.0, -1.0)
    weights = 1 / np.bincount([r["class"] for r in sample], minlength=len(languages)).clip(1)[[r["class"] for r in sample]]
    ones = np.hstack([x, np.ones((len(x), 1))])
    solved = np.linalg.solve(ones.T @ (ones * weights[:, None]) + RIDGE * np.eye(ones.shape[1]), ones.T @ (y * weights[:, None]))
    model.weights = np.vstack([root @ solved[:-1], solved[-1:]])
    return model


def pieces(batch: pd.DataFrame, rows: int) -> Iterator[pd.DataFrame]:
    for at in range(0, len(batch), rows):
        yield batch.iloc[at : at + rows]


def identify(documents: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """``documents`` without the text, with lang_pred and score (0 to 1).

    A null text and one without a letter are ``und`` with score 0, as is everything where nothing could be learned. Of equal
    scores the first language in code point order is taken. Whole texts are read; repeated rows get equal results; columns of
    the input that clash with the results are replaced.
    """
    kept = [c for c in documents.columns if c not in (text, "lang_pred", "score")]
    rows = documents.select(*kept, F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).alias("__text"))
    if model is None:
        return rows.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for batch in batches:
            for part in pieces(batch, ROWS_PER_PRODUCT):
                names, scores = np.full(len(part), "und", object), np.zeros(len(part))
                here = np.flatnonzero(part["__text"].notna().to_numpy())
                if len(here):
                    found = own.scores(list(part["__text"].iloc[here]))
                    best = found.round(9).argmax(axis=1)
                    names[here] = np.array(own.languages, object)[best]
                    scores[here] = ((found[np.arange(len(here)), best] + 1) / 2).clip(0, 1).round(6)
                yield part[kept].assign(lang_pred=names, score=scores)

    return rows.mapInPandas(predict, extended(rows.select(*kept), "lang_pred string, score double"))


def op1_language_id(spark: SparkSession, path: str) -> DataFrame:
    """The language of every document, learned from documents outside the held-out quarter; see :func:`identify`."""
    documents = read(spark, path, "documents").select("doc_id", "text", "lang").withColumn("held_out", bucket("doc_id", 4) == 2)
    model = fit_language_model(documents.filter("NOT held_out"))
    return identify(documents.drop("lang"), model)
