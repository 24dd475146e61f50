"""Near copies of documents: SetSketch registers in bands find pairs, a joint likelihood estimates them, full sets confirm."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import components, join_counted, read
from plumbline.plans.durable import cut_lineage

SHINGLE = 5
#: Documents are linked when 100 shared shingles stand against no more than 100/0.75 in both together.
SHARED, OF = 75, 100
#: A register holds how far the least of a document's exponential hash values lies, in steps of a factor 1.02.
BASE, RATE, TOP = 1.02, 20.0, 4095
#: 51 bands of 5 registers: at similarity 0.75 all bands differ for one pair in a million.
BANDS, BAND = 51, 5
REGISTERS = BANDS * BAND
#: An estimate may fall this far short of the threshold before a pair is given up: five standard errors.
MARGIN = 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
#: A bucket with more classes than this is dealt out anew by further registers: so many bands of so many of them. At similarity
#: 0.75 a level misses one pair in 1.5 million, no more than the bands do.
CROWD, FINER_BANDS, FINER, LEVELS = 4_000, 26, 3, 3
#: Before classes of one bucket are brought together, one bit each of so many further minima is compared: linked pairs agree in 7
#: of 8. A pair that differs in more bits than a linked one would by five standard errors is left out.
LOOK_BITS = 4_096
MOST_DIFFERENT = int(LOOK_BITS / 8 + 5 * (LOOK_BITS * 7 / 64) ** 0.5) + 1
#: Identifiers of candidates are broadcast up to this number (16 MB); beyond it, texts are joined by a shuffle.
BROADCAST_IDS = 250_000
ROWS_AT_ONCE = 500
_made = np.random.default_rng(3)
MULTIPLIERS = _made.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SALTS = _made.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
LOOK_MULTIPLIERS = _made.integers(1, 1 << 63, LOOK_BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOOK_SALTS = _made.integers(0, 1 << 63, LOOK_BITS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)
BAND_MIX = _made.integers(1, 1 << 62, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted: five words each, or all words of a shorter text; none without words.

    Letters A-Z are lower-cased; words are cut at white space (space, tab to carriage return).
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    wide = min(SHINGLE, len(w))
    h = np.full(len(w) - wide + 1, np.uint64(wide))
    for j in range(wide):
        h = (h ^ w[j : len(w) - wide + 1 + j]) * MIX
        h ^= h >> np.uint64(29)
    h.sort()
    keep = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]


def sketch(elements: np.ndarray) -> np.ndarray:
    """The registers of a set. Two sets' registers for their union are the larger of each (see :func:`merge`)."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 512):
        part = (elements[at : at + 512, None] ^ SALTS[None, :]) * MULTIPLIERS[None, :]
        part ^= part >> np.uint64(32)
        part *= MIX
        np.minimum(least, part.min(axis=0), out=least)
    # the least of uniform values is, after the logarithm, the least of exponential ones
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers."""
    parts = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, parts.shape[:2]).copy()
    for j in range(BAND):
        h = (h ^ parts[:, :, j]) * BAND_MIX[j]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def finer_keys(registers: np.ndarray, buckets: np.ndarray, level: int) -> np.ndarray:
    """Keys of a bucket's parts: the bucket's key with three further registers, once for each finer band."""
    chosen = np.random.default_rng(100 + level).permutation(REGISTERS)[: FINER_BANDS * FINER].reshape(FINER_BANDS, FINER)
    h = buckets.view(np.uint64)[:, None] ^ (np.arange(1, FINER_BANDS + 1, dtype=np.uint64) * MIX)[None, :]
    for j in range(FINER):
        h = (h ^ registers[:, chosen[:, j]].astype(np.uint64)) * BAND_MIX[j]
        h ^= h >> np.uint64(31)
    return h.view(np.int64)


def look(elements: np.ndarray) -> np.ndarray:
    """One bit of each of many minima of a set, 64 to a word: two sets differ in half as many bits as their minima."""
    least = np.full(LOOK_BITS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 64):
        part = (elements[at : at + 64, None] ^ LOOK_SALTS[None, :]) * LOOK_MULTIPLIERS[None, :]
        part ^= part >> np.uint64(32)
        part *= MIX
        np.minimum(least, part.min(axis=0), out=least)
    return np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)


def different_bits(one: str, other: str) -> Column:
    """In how many bits two arrays of words differ."""
    total = F.lit(0)
    for i in range(LOOK_BITS // 64):
        total = total + F.bit_count(F.col(one)[i].bitwiseXOR(F.col(other)[i]))
    return total


def joint_similarity(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray) -> np.ndarray:
    """The most likely Jaccard similarity of pairs of sets, from their registers and known sizes.

    How many registers of one set are larger, smaller and equal follows from the similarity, the sizes and the base; the
    likelihood is concave, so thirds are cut off until its top is found.
    """
    more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
    same = x.shape[1] - more - less
    u = n_x / (n_x + n_y)
    v = 1 - u
    larger = lambda p: -np.log1p(-np.clip(p, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        a, b = larger(u - v * j), larger(v - u * j)
        return more * np.log(a + 1e-12) + less * np.log(b + 1e-12) + same * np.log(np.maximum(1 - a - b, 1e-12))

    low, high = np.zeros(len(x)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        up = likelihood(low + third) < likelihood(high - third)
        low, high = np.where(up, low + third, low), np.where(up, high, high - third)
    return (low + high) / 2


def _sketch_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[at : at + ROWS_AT_ONCE]
            out = []
            for text in part["text"]:
                s = shingles(text)
                out.append((len(s), set_key(s), sketch(s).tobytes()) if len(s) else (0, None, None))
            yield pd.DataFrame(out, columns=["n", "set_key", "registers"]).assign(id=part["id"].to_numpy(), own=part["own"].to_numpy())[["id", "own", "n", "set_key", "registers"]]


def set_key(elements: np.ndarray) -> str:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).hexdigest()


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), REGISTERS)


def _place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.iloc[at : at + 2000]
            yield pd.DataFrame({"class": np.repeat(part["class"].to_numpy(), BANDS), "bucket": band_keys(_registers(part["registers"])).ravel()})


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            looks = [look(np.frombuffer(e, np.uint64)) for e in batch["elements"]]
            yield batch[["class", "size"]].assign(look=looks)


def _likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            found = joint_similarity(_registers(batch["registers_a"]), _registers(batch["registers_b"]), batch["n_a"].to_numpy(float), batch["n_b"].to_numpy(float))
            yield batch[found >= SHARED / OF - MARGIN][["a", "b"]]


def _full_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            part = batch.iloc[at : at + ROWS_AT_ONCE]
            yield pd.DataFrame({"class": part["class"], "elements": [shingles(t).tobytes() for t in part["text"]]})


def _confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        keep = []
        for one, other in zip(batch["elements_a"], batch["elements_b"], strict=True):
            a, b = np.frombuffer(one, np.uint64), np.frombuffer(other, np.uint64)
            if len(a) > len(b):
                a, b = b, a
            at = np.searchsorted(b, a)
            at[at == len(b)] = 0
            shared = int((b[at] == a).sum())
            keep.append(OF * shared >= SHARED * (len(a) + len(b) - shared))
        yield batch[np.array(keep, bool)][["a", "b"]]


class _Search:
    """Documents, their classes (one for each distinct set) and what it takes to compare classes."""

    def __init__(self, documents: DataFrame, classes: DataFrame):
        self.documents, self.classes = documents, classes
        self.sets: DataFrame | None = None

    def read_sets(self, wanted: DataFrame) -> None:
        """Compute the full sets of the classes that share a bucket with another, once for all rounds."""
        wanted = cut_lineage(wanted.select("class").distinct().join(self.classes.select("class", F.col("least").alias("id"), "own"), "class"))
        texts = self.documents.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, ["id", "own"]).select("class", "text")
        self.sets = cut_lineage(texts.mapInPandas(_full_sets, "class bigint, elements binary").dropDuplicates(["class"]))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked: a first look at both sketches, then the full sets."""
        side = lambda s: self.classes.select(F.col("class").alias(s), F.col("registers").alias(f"registers_{s}"), F.col("n").alias(f"n_{s}"))
        possible = F.col("n_a") * OF >= F.col("n_b") * SHARED, F.col("n_b") * OF >= F.col("n_a") * SHARED
        seen = pairs.join(side("a"), "a").join(side("b"), "b").filter(possible[0] & possible[1])
        likely = cut_lineage(seen.mapInPandas(_likely, "a bigint, b bigint"))
        full = lambda s: self.sets.select(F.col("class").alias(s), F.col("elements").alias(f"elements_{s}"))
        return cut_lineage(likely.join(full("a"), "a").join(full("b"), "b").mapInPandas(_confirm, "a bigint, b bigint"))


def near_copies(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: its set's size and the smallest document it is linked with, over others.

    1. Documents with equal shingle sets form a class. 2. Classes that agree on a band of registers share a bucket. 3. Every
    class is compared with the smallest of its buckets, and linked classes are joined to components. 4. Then only classes of one
    bucket whose components still differ are compared with each other; crowded buckets are first dealt out by further registers.
    So a group of thousands of copies costs a comparison each, not one for each two of them; no bucket is cut.

    Links are confirmed on full sets of 64-bit shingle hashes. Null and empty texts have no shingles and are linked with nothing,
    nor are rows without identifier. Repeated rows are in one component; rows with one identifier and different texts are compared
    each by its own text. There is a row for each row of the input; an empty table gives none. Identifiers are integers. Only the
    two named columns are read, so other names cannot clash.

    A class has a number of its own. Its text is found again by the smallest identifier and the hash of that row's text.
    """
    rows = documents.select(F.col(id).cast("long").alias("id"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("own"), F.col(text).alias("text"))
    sketched = cut_lineage(rows.mapInPandas(_sketch_rows, "id bigint, own string, n bigint, set_key string, registers binary"))
    found = sketched.filter("set_key IS NOT NULL AND id IS NOT NULL")
    grouped = found.groupBy("set_key").agg(
        F.min(F.struct("id", "own")).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("registers").alias("registers")
    )
    numbered = F.monotonically_increasing_id().alias("class")
    classes = cut_lineage(grouped.select("set_key", numbered, F.col("first.id").alias("least"), F.col("first.own").alias("own"), "copies", "n", "registers"))
    placed = classes.select("class", "registers").mapInPandas(_place, "class bigint, bucket bigint")
    buckets = cut_lineage(placed.groupBy("bucket").agg(F.min("class").alias("least"), F.count(F.lit(1)).alias("members")).filter("members > 1"))
    met = buckets.agg(F.sum("members")).first()[0] or 0
    together = cut_lineage(join_counted(placed, buckets, ["bucket"], "members", met).filter("least IS NOT NULL"))
    search = _Search(rows, classes)
    search.read_sets(together)
    first = cut_lineage(together.filter("class != least").select(F.col("least").alias("a"), F.col("class").alias("b")).distinct())
    links = search.confirmed(first)
    nodes = together.select(F.col("class").alias("node")).distinct()
    grouped = cut_lineage(components(nodes, links))
    apart = _still_apart(together.select("bucket", "class"), grouped, met)
    pairs = _pairs_apart(apart, classes, search.sets).join(first, ["a", "b"], "left_anti")
    more = search.confirmed(pairs)
    final = cut_lineage(components(classes.select(F.col("class").alias("node")), links.union(more)))
    of_class = cut_lineage(classes.select("set_key", "class", "copies", "least").join(final, F.col("class") == F.col("node")).select("set_key", "copies", "least", "component"))
    lowest = cut_lineage(of_class.groupBy("component").agg(F.min("least").alias("smallest"), F.count(F.lit(1)).alias("classes")).filter("classes > 1"))
    linked = lowest.agg(F.sum("classes")).first()[0] or 0
    named = join_counted(of_class, lowest, ["component"], "classes", linked)
    named = cut_lineage(named.select("set_key", "copies", F.coalesce("smallest", "least").alias("component")))
    total = named.agg(F.sum("copies")).first()[0] or 0
    asked = sketched.select("id", "n", F.when(F.col("id").isNull() | F.col("set_key").isNull(), F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")))).otherwise(F.col("set_key")).alias("set_key"))
    known = join_counted(asked, named, ["set_key"], "copies", total)
    component = F.coalesce("component", "id")
    return known.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _still_apart(together: DataFrame, grouped: DataFrame, met: int) -> DataFrame:
    """(bucket, class, component) of the buckets that hold more than one component."""
    rows = cut_lineage(together.join(grouped, F.col("class") == F.col("node")).select("bucket", "class", "component"))
    mixed = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
    mixed = cut_lineage(mixed.filter("low < high").select("bucket", "members"))
    return cut_lineage(join_counted(rows, mixed, ["bucket"], "members", met).filter("members IS NOT NULL"))


def _pairs_apart(apart: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a < b) of classes that share a bucket but not a component and look alike, crowded buckets dealt out anew first."""
    ready = apart.filter(F.col("members") <= CROWD).select("bucket", "class", "component", F.lit(False).alias("dealt"))
    crowded = apart.filter(F.col("members") > CROWD).select("bucket", "class", "component")
    for level in range(LEVELS):
        if crowded.isEmpty():
            break

        def deal(batches: Iterator[pd.DataFrame], level: int = level) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 2000):
                    part = batch.iloc[at : at + 2000]
                    keys = finer_keys(_registers(part["registers"]), part["bucket"].to_numpy(np.int64), level)
                    again = np.repeat(np.arange(len(part)), FINER_BANDS)
                    yield part[["class", "component"]].iloc[again].assign(bucket=keys.ravel())

        wide = crowded.join(classes.select("class", "registers"), "class")
        dealt = cut_lineage(wide.mapInPandas(deal, "class bigint, component bigint, bucket bigint").select("bucket", "class", "component"))
        counted = cut_lineage(
            dealt.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members"))
            .filter("low < high").select("bucket", "members")
        )
        total = counted.agg(F.sum("members")).first()[0] or 0
        split = cut_lineage(join_counted(dealt, counted, ["bucket"], "members", total).filter("members IS NOT NULL"))
        last = level == LEVELS - 1
        ready = ready.union(split.filter(F.lit(last) | (F.col("members") <= CROWD)).select("bucket", "class", "component", F.lit(True)))
        crowded = split.filter(~F.lit(last) & (F.col("members") > CROWD)).select("bucket", "class", "component")
    wanted = cut_lineage(ready.select("class").distinct())
    of_class = classes.select("class", F.col("n").alias("size")).join(wanted, "class", "left_semi").join(sets, "class")
    looks = cut_lineage(of_class.mapInPandas(_look, "class bigint, size bigint, look array<bigint>"))
    # the uncrowded buckets of a class that are compared here: at most one for each band
    own = ready.filter(~F.col("dealt")).groupBy("class").agg(F.sort_array(F.collect_set("bucket")).alias("keys"))
    looks = cut_lineage(looks.join(own, "class", "left"))
    ready = ready.join(looks, "class")
    one = ready.select("bucket", F.col("class").alias("x"), F.col("component").alias("c"), F.col("look").alias("one"), F.col("size").alias("n"), F.col("keys").alias("k"), "dealt")
    other = ready.select("bucket", F.col("class").alias("y"), F.col("component").alias("d"), F.col("look").alias("other"), F.col("size").alias("m"), F.col("keys").alias("l"))
    alike = (F.col("n") * OF >= F.col("m") * SHARED) & (F.col("m") * OF >= F.col("n") * SHARED) & (different_bits("one", "other") <= MOST_DIFFERENT)
    # of the uncrowded buckets that a pair shares, the first brings it together
    once = F.col("dealt") | (F.element_at(F.array_intersect("k", "l"), 1) == F.col("bucket"))
    crossing = one.join(other, "bucket").filter((F.col("c") < F.col("d")) & alike & once)
    return cut_lineage(crossing.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


def drop_near_copies(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier; all columns as they came."""
    kept = near_copies(documents, id, text).filter("kept").select(F.col(id).alias("__kept")).distinct()
    return documents.join(kept, F.col(id).cast("long").eqNullSafe(F.col("__kept")), "left_semi")


def op3_near_copies(spark: SparkSession, path: str) -> DataFrame:
    """The near-copy group of every document; see :func:`near_copies`."""
    return near_copies(read(spark, path, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) END AS s
  FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
lowest AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN lowest ON a = doc_id
"""
