"""Toxicity: logistic regression whose scores must not move when identity terms are swapped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import bucket, extended, read, share

#: Terms that name groups of people, by language and kind of group; swapping one for another must not change a score.
IDENTITY_GROUPS = tuple(
    group.split()
    for group in (
        "women men girls boys",
        "gay lesbian straight transgender",
        "muslim christian jewish hindu buddhist atheist",
        "black white asian african european american mexican",
        "immigrant refugee",
        "disabled deaf blind",
        "old young",
        "frauen männer",
        "muslime christen juden",
        "schwarze weisse",
        "femmes hommes",
        "musulmans chrétiens juifs",
        "noirs blancs",
        "mujeres hombres",
        "musulmanes cristianos judíos",
        "negros blancos",
    )
)
IDENTITY_TERMS = [term for group in IDENTITY_GROUPS for term in group]
#: Bounds of the fit: labelled rows of each label (an expected number, drawn by a hash), and word or prefix features.
LABEL_ROWS = 8_000
FEATURES = 2_048
PREFIXES = (3, 4, 5, 6)
L2, COUNTERFACTUAL = 1e-4, 1.0
STEPS = 300
WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None, swap: dict[str, str] | None = None) -> set[str]:
    """The words of a text (runs of letters, lower-cased), and their beginnings of 3 to 6 letters; ``swap`` replaces words."""
    words = set(WORDS.findall((text or "").lower()))
    if swap:
        words = {swap.get(w, w) for w in words}
    found = {w + "." for w in words}
    for n in PREFIXES:
        found.update(w[:n] for w in words if len(w) > n)
    return found


def swapped() -> dict[str, str]:
    """Each identity term with the next one of its language and kind in its place."""
    return {term: other for group in IDENTITY_GROUPS for term, other in zip(group, [*group[1:], group[0]], strict=True)}


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None) -> float:
        words = WORDS.findall((text or "").lower())
        weights = self.weights
        total = self.bias
        for f in features(text) & weights.keys() if words else ():
            total += weights[f]
        return round(float(1 / (1 + np.exp(-np.clip(total, -30, 30)))), 6)


def fit_toxicity(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> ToxicityModel:
    """Fit on the labelled documents (labels: id, toxic 0 or 1; null labels are passed over, of several for a row the largest holds).

    A bounded number of rows of each label is drawn by a hash of their identifiers, whatever the size, and only those are
    broadcast; a rare label is thus not drawn away, and the bias is corrected for the shares drawn. Words and beginnings are
    counted in Spark; the most telling ones become features. The driver then fits a logistic regression with a penalty on large
    weights and one on the square of each row's change of score when its identity terms are swapped. Without both labels, the
    score is 0 or 1 everywhere as the label known says, else 0.
    """
    known = labels.filter(F.col(toxic).isNotNull()).groupBy(id).agg(F.max(toxic).cast("int").alias("__y"))
    shares = {r["__y"]: LABEL_ROWS / r["count"] for r in known.groupBy("__y").count().collect()}
    drawn = known.filter(share(id) < F.when(F.col("__y") == 1, F.lit(shares.get(1, 1.0))).otherwise(F.lit(shares.get(0, 1.0))))
    rows = documents.select(id, text).join(F.broadcast(drawn), id).select("__y", text)
    swap = swapped()
    terms = set(IDENTITY_TERMS)

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts: dict[str, list[int]] = {}
            for y, value in zip(batch["__y"], batch[text], strict=True):
                for f in features(value):
                    counts.setdefault(f, [0, 0])[int(y)] += 1
            if counts:
                yield pd.DataFrame({"feature": list(counts), "clean": [c[0] for c in counts.values()], "toxic": [c[1] for c in counts.values()]})

    counted = rows.mapInPandas(spell, "feature string, clean bigint, toxic bigint").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    sizes = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    clean, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not clean or not bad:
        return ToxicityModel({}, 30.0 if bad else -30.0)
    # how far the shares of both classes differ, in standard errors: rare words alone cannot stand out
    p = (F.col("clean") + F.col("toxic") + 1) / F.lit(float(clean + bad + 2))
    apart = F.abs(F.col("toxic") / F.lit(float(bad)) - F.col("clean") / F.lit(float(clean))) / F.sqrt(p * (1 - p) * (1 / clean + 1 / bad))
    chosen = counted.filter(F.col("clean") + F.col("toxic") >= 2).withColumn("apart", F.round(apart, 6)).orderBy(F.desc("apart"), "feature").limit(FEATURES)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    column = {f: j for j, f in enumerate(names)}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {"y": [], "x": [], "x2": []}
            for y, value in zip(batch["__y"], batch[text], strict=True):
                own = features(value)
                other = features(value, swap) if terms & set(WORDS.findall((value or "").lower())) else own
                out["y"].append(int(y))
                out["x"].append(np.array(sorted(column[f] for f in own & column.keys()), np.int16))
                out["x2"].append(np.array(sorted(column[f] for f in other & column.keys()), np.int16) if other is not own else None)
            yield pd.DataFrame(out)

    sample = rows.mapInPandas(encode, "y int, x array<smallint>, x2 array<smallint>").collect()
    sample.sort(key=lambda r: (r["y"], r["x"]))
    x = np.zeros((len(sample), len(names)), np.float32)
    moved = []
    for i, row in enumerate(sample):
        x[i, row["x"]] = 1
        if row["x2"] is not None:
            change = np.zeros(len(names), np.float32)
            change[row["x"]] += 1
            change[row["x2"]] -= 1
            moved.append(change)
    weights, bias = _solve(x, np.array([r["y"] for r in sample], np.float32), np.array(moved, np.float32))
    bias += np.log(min(shares[0], 1.0) / min(shares[1], 1.0))
    return ToxicityModel({f: float(w) for f, w in zip(names, weights, strict=True) if w}, float(bias))


def _solve(x: np.ndarray, y: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, float]:
    """Accelerated gradient descent on mean log loss, L2, and the mean squared change of score under swaps."""
    n = len(x)
    top = np.ones(x.shape[1], np.float32)
    for _ in range(10):  # the largest eigenvalue bounds the step
        top = x.T @ (x @ top)
        top /= np.linalg.norm(top)
    curve = float(np.linalg.norm(x @ top) ** 2) / n / 4 + 0.25 + L2
    if len(moved):
        curve += 2 * COUNTERFACTUAL * float((moved**2).sum()) / n
    w, b = np.zeros(x.shape[1], np.float32), np.float32(np.log(max(y.sum(), 1) / max(n - y.sum(), 1)))
    v, c = w.copy(), b
    for step in range(STEPS):
        off = 1 / (1 + np.exp(-np.clip(x @ v + c, -30, 30))) - y
        gradient = x.T @ off / n + L2 * v
        if len(moved):
            gradient += 2 * COUNTERFACTUAL * moved.T @ (moved @ v) / n
        w2, b2 = v - gradient / curve, c - off.mean() / curve
        pull = step / (step + 3)
        v, c = w2 + pull * (w2 - w), b2 + pull * (b2 - b)
        w, b = w2, b2
    return w, float(b)


def score_toxicity(documents: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``documents`` without the text, with score (0 to 1) and predicted (1 from 0.5).

    Whole texts are read. Null and empty texts, and texts without letters, get the score of a text without features. Equal
    texts get equal scores, repeated rows too; input columns that clash with the results are replaced.
    """
    kept = [c for c in documents.columns if c not in (text, "score", "predicted")]
    rows = documents.select(*kept, F.col(text).alias("__text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            model = shared.value
            scores = np.array([model.score(t) for t in batch["__text"]], float)
            yield batch[kept].assign(score=scores, predicted=(scores >= 0.5).astype("int32"))

    return rows.mapInPandas(judge, extended(rows.select(*kept), "score double, predicted int"))


def reject_toxic(documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents whose score stays below 0.5, all columns as they came."""
    model = fit_toxicity(documents.filter(bucket(id, 5) != 0), labels, id, text)
    own = documents.columns
    rows = documents.select(*(F.col(c).alias(f"own_{c}") for c in own), F.col(text).alias("text"))  # no name clashes with a result
    clean = score_toxicity(rows, model).filter("predicted = 0")
    return clean.select(*(F.col(f"own_{c}").alias(c) for c in own))


def op10_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """The toxicity of every document, learned from labels outside the held-out fifth; see :func:`score_toxicity`."""
    documents = read(spark, path, "documents").select("doc_id", "text").withColumn("held_out", bucket("doc_id", 5) == 0)
    labels = read(spark, path, "labels").select("doc_id", "toxic").filter(bucket("doc_id", 5) != 0)
    return score_toxicity(documents, fit_toxicity(documents, labels))
