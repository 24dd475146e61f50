"""Benchmark decontamination over a positional inverted index: lists of the rarest test words are intersected by their offsets."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.frames import small_frame
from plumbline.llm.common import lower_ascii, read, text_of
from plumbline.plans.durable import cut_lineage, scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in bytes: letters A-Z become small, other bytes outside words become a space. Longer characters are words.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
WINDOW = 10
#: Words of documents that make a block of the index (a longer document is a block of its own); bytes of text split at a time.
BLOCK_WORDS, TEXT_PIECE = 1 << 20, 1 << 22
#: Words of test items that are searched for at a time, and windows of one piece of a long item. A batch is what a task is sent.
BATCH_WORDS, ITEM_PIECE = 1 << 19, 1 << 12
#: Places looked at in one step, which bounds a task's memory.
STEP = 1 << 21
MATCHES = "block long, place int, classes array<string>, firsts array<long>, lasts array<long>"
INDEX = "block long, term string, n long, places binary, starts array<long>, sizes array<long>"


def word_numbers(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a text; words new to the vocabulary get the next number. Split piece by piece, at spaces."""
    text = text.translate(WORD_BYTES)
    parts, at = [np.empty(0, np.int32)], 0
    while at < len(text):
        end = at + TEXT_PIECE
        end = len(text) if end >= len(text) else (text.find(b" ", end) + 1 or len(text))
        words = text[at:end].split()
        parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(parts)


def posting_lists(numbers: np.ndarray, places: np.ndarray, terms: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(term numbers, counts, bytes) of all lists, by width: each list holds the steps between its places in 1, 2 or 4 bytes."""
    order = np.sort((numbers.astype(np.int64) << 32) | places)
    number, place = order >> 32, order & 0xFFFFFFFF
    counts = np.bincount(number, minlength=terms)
    first = np.cumsum(counts) - counts
    steps = np.diff(place, prepend=0)
    steps[first] = place[first]
    largest = np.maximum.reduceat(steps, first)
    width = np.where(largest < 1 << 8, 1, np.where(largest < 1 << 16, 2, 4))
    for bytes_each in (1, 2, 4):
        chosen = np.flatnonzero(width == bytes_each)
        if len(chosen):
            yield chosen, counts[chosen], steps[np.repeat(width == bytes_each, counts)].astype(f"<u{bytes_each}").view(np.uint8)


def places_of(packed: bytes, n: int) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, f"<u{len(packed) // n}").astype(np.int64))


def _binaries(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _index_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, sequence, kind = TaskContext.get().partitionId(), count(), None
    vocabulary: dict[bytes, int] = defaultdict(count().__next__)
    numbers, ids, sizes, words = [], [], [], 0

    def block() -> Iterator[pa.RecordBatch]:
        own = (part << 32) + next(sequence)
        starts = np.cumsum([0, *(n + 1 for n in sizes[:-1])]).astype(np.int64)  # a place between two documents belongs to none
        names, lists = ("block", "term", "n", "places", "starts", "sizes", "ids"), (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(kind))

        def rows(terms: list, n: list, places: pa.Array, directory: tuple | None = None) -> pa.RecordBatch:
            columns = [pa.array([own] * len(terms), pa.int64()), pa.array(terms, pa.string()), pa.array(n, pa.int64()), places]
            columns += [pa.array([directory[i]], t) if directory else pa.nulls(len(terms), t) for i, t in enumerate(lists)]
            return pa.RecordBatch.from_arrays(columns, names)

        yield rows([""], [words], pa.nulls(1, pa.binary()), (starts, sizes, ids))
        if words:
            spelled = np.array([w.decode("utf-8", "replace") for w in vocabulary], object)
            own_places = np.concatenate([start + np.arange(n) for start, n in zip(starts, sizes)])
            for terms, n, data in posting_lists(np.concatenate(numbers), own_places, len(spelled)):
                yield rows(list(spelled[terms]), n, _binaries(n * (len(data) // n.sum()), data))

    for batch in batches:
        kind = batch.schema.field(0).type
        for id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = word_numbers(text.as_py() or b"", vocabulary)
            numbers.append(own)
            ids.append(id)
            sizes.append(len(own))
            words += len(own)
            if words + len(ids) >= BLOCK_WORDS:
                yield from block()
                vocabulary = defaultdict(count().__next__)
                numbers, ids, sizes, words = [], [], [], 0
    if ids:
        yield from block()


def build_index(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The positional index of all words of all documents, written to the shared folder: (block, term, n, places, ...).

    A task cuts its documents into blocks of about a million words and writes, for each word of a block, the list of all its
    places, without a shuffle; a word that stands in every document has one short list in each block. The row with the empty
    term is the block's directory: its documents' identifiers, first places and sizes.
    """
    kind = documents.schema[id].dataType.simpleString()
    folder = scratch(documents.sparkSession, "positional-index")
    rows = documents.select(F.col(id).alias("id"), F.col(text).cast("string").cast("binary").alias("text"))
    rows.mapInArrow(_index_task, f"{INDEX}, ids array<{kind}>").write.option("compression", "zstd").parquet(folder)
    return documents.sparkSession.read.parquet(folder)


def item_words(text: str) -> Column:
    return F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(WORD), F.lit(0))


def phrases(benchmark: DataFrame, window: int = WINDOW, id: str = "item_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(pieces, items): (class, batch, words) of different items, and the identifiers (class, item) of each.

    Items of the same words are one class and are searched for once. Long items are cut into pieces that overlap by a window
    less one word, so that every window is in a piece; pieces are dealt to as many batches as their words fill.
    """
    worded = benchmark.select(F.col(id).cast("string").alias("item"), item_words(text).alias("words")).filter(F.size("words") > 0)
    classed = worded.withColumn("class", F.md5(F.concat_ws(" ", "words")))
    items = cut_lineage(classed.filter("item IS NOT NULL").select("class", "item").distinct())
    different = classed.groupBy("class").agg(F.first("words").alias("words"))
    last = F.greatest(F.size("words") - window, F.lit(0))
    cut = different.select("class", "words", F.explode(F.sequence(F.lit(0), last, F.lit(ITEM_PIECE))).alias("at"))
    pieces = cut_lineage(cut.select("class", "at", F.slice("words", F.col("at") + 1, ITEM_PIECE + window - 1).alias("words")))
    total = pieces.agg(F.sum(F.size("words"))).first()[0] or 0
    batches = -(-total // BATCH_WORDS)
    return pieces.select("class", F.pmod(F.xxhash64("class", "at"), F.lit(max(batches, 1))).alias("batch"), "words"), items


class Wanted:
    """The different windows of one batch of pieces, as numbers of words, and the order in which their words are looked at."""

    def __init__(self, pieces: list, window: int):
        self.terms: dict[str, int] = {}
        self.classes = sorted({p["class"] for p in pieces})
        known = {c: i for i, c in enumerate(self.classes)}
        rows, owners = [], []
        for piece in pieces:
            words = np.array([self.terms.setdefault(w, len(self.terms)) for w in piece["words"]], np.int32)
            made = np.full((max(len(words) - window + 1, 1), window), -1, np.int32)
            if len(words) < window:
                made[0, : len(words)] = words
            else:
                made[:] = np.lib.stride_tricks.sliding_window_view(words, window)
            rows.append(made)
            owners.append(np.full(len(made), known[piece["class"]], np.int32))
        self.windows, which = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], axis=1), axis=0)
        self.owners, self.first_owner = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))

    def rarest_first(self, counts: dict[str, int]) -> None:
        """Keep the windows whose words all occur, and order each one's places by how often its words occur (ties: the first)."""
        often = np.array([counts.get(t, 0) for t in self.terms] + [np.iinfo(np.int64).max], np.int64)[self.windows]
        alive = (often > 0).all(axis=1)
        ranges = [np.arange(a, b) for a, b in zip(self.first_owner[:-1][alive], self.first_owner[1:][alive])]
        self.windows, often = self.windows[alive], often[alive]
        self.owners = self.owners[np.concatenate([np.empty(0, np.int64), *ranges]).astype(np.int64)]
        self.first_owner = np.concatenate([[0], np.cumsum([len(r) for r in ranges])]).astype(np.int64)
        self.order = np.argsort(often, axis=1, kind="stable")  # missing words of short windows come last
        self.long = (self.windows >= 0).sum(axis=1)
        used = set(np.unique(self.windows[self.windows >= 0]).tolist())
        self.terms = {t: i for t, i in self.terms.items() if i in used}

    def search(self, lists: dict[int, np.ndarray], starts: np.ndarray, end: int, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, first place, last place) of all matches in a block.

        The places of a window's rarest word, less its offset, are where the window may begin. The next words' lists, rarest
        first, thin these out: a place stays where the list has an entry at the place plus the word's offset, or, with ``slack``,
        within so many words of it in the same document. Lists are looked up by place, for all windows at once.
        """
        if not len(self.windows):
            return
        at = np.full(end + 1, -1, np.int32)
        for term, places in lists.items():
            at[places] = term
        document = np.zeros(end + 1, np.int32)
        document[starts[starts < end]] = 1
        document = np.cumsum(document)
        many = np.zeros(max(int(self.windows.max()) + 2, 1), np.int64)
        for term, places in lists.items():
            many[term] = len(places)
        many[-1] = 1  # stands for the missing words
        alive = np.flatnonzero((many[self.windows] > 0).all(axis=1))
        rarest = self.windows[alive, self.order[alive, 0]]
        before = np.concatenate([[0], np.cumsum(many[rarest])])
        tries = sorted(range(-slack, slack + 1), key=abs)
        cut = 0
        while cut < len(alive):
            until = max(int(np.searchsorted(before, before[cut] + STEP, "right")) - 1, cut + 1)
            for lower in range(0, int(many[rarest[cut]]) if until == cut + 1 else 1, STEP):
                chosen = [lists[t][lower : lower + STEP] for t in rarest[cut:until]]
                window = np.repeat(alive[cut:until], [len(c) for c in chosen])
                place = np.concatenate(chosen)
                begin, first, last = place - self.order[window, 0], place, place
                for rank in range(1, self.windows.shape[1]):
                    offset = self.order[window, rank]
                    term = self.windows[window, offset]
                    found = np.where(term < 0, place, -1)
                    for step in tries:
                        spot = begin + offset + step
                        inside = (found < 0) & (spot >= 0) & (spot < end)
                        spot = np.where(inside, spot, 0)
                        found = np.where(inside & (at[spot] == term) & (document[spot] == document[place]), spot, found)
                    stays = found >= 0
                    window, place, begin, found = window[stays], place[stays], begin[stays], found[stays]
                    first, last = np.minimum(first[stays], found), np.maximum(last[stays], found)
                if len(window):
                    yield window, first, last
            cut = until


def matcher(wanted: Wanted, slack: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def match(frame: pd.DataFrame) -> pd.DataFrame:
        directory = frame[frame["term"] == ""].iloc[0]
        starts, sizes = directory["starts"], directory["sizes"]
        end = int(starts[-1] + sizes[-1] + 1)
        lists = {wanted.terms[t]: places_of(p, int(n)) for t, p, n in zip(frame["term"], frame["places"], frame["n"]) if t}
        hit, named = np.zeros(end + 1, np.int32), [np.empty((0, 2), np.int64)]
        for window, first, last in wanted.search(lists, starts, end, slack):
            np.add.at(hit, first, 1)
            np.add.at(hit, last + 1, -1)
            owners = wanted.first_owner[window + 1] - wanted.first_owner[window]
            which = np.repeat(wanted.first_owner[window] - np.cumsum(owners) + owners, owners) + np.arange(owners.sum())
            document = np.searchsorted(starts, first, "right") - 1
            named.append(np.unique(np.stack([np.repeat(document, owners), wanted.owners[which]], axis=1), axis=0))
        pairs = np.unique(np.concatenate(named), axis=0)
        inside = np.diff(np.concatenate([[0], np.cumsum(hit) > 0, [0]]).astype(np.int8))
        firsts, lasts = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1) - 1
        of_run = np.searchsorted(starts, firsts, "right") - 1
        rows = []
        for document in np.unique(pairs[:, 0]):
            runs = of_run == document if len(of_run) < 64 else slice(*np.searchsorted(of_run, [document, document + 1]))
            own = pairs[slice(*np.searchsorted(pairs[:, 0], [document, document + 1])), 1]
            rows.append((directory["block"], int(document), [wanted.classes[c] for c in own], firsts[runs] - starts[document], lasts[runs] - starts[document]))
        return pd.DataFrame(rows, columns=["block", "place", "classes", "firsts", "lasts"])

    return match


def find_phrases(index: DataFrame, pieces: DataFrame, window: int = WINDOW, slack: int = 0) -> DataFrame:
    """(block, place, classes, firsts, lasts): the documents (by block and place in it) with matches, their items and the spans of
    matched words, which neither overlap nor touch.

    With ``slack`` 0 the words of a window stand one after another; otherwise each stands within so many words of the place it
    should have, seen from the window's rarest word. Batches of pieces are searched for one after another, each in all blocks.
    A batch has about half a million words, which bounds what each task is sent; the index lists of its words, only, are dealt out
    by block.
    """
    spark = index.sparkSession
    found = []
    for batch in range((pieces.agg(F.max("batch")).first()[0] or 0) + 1):
        own = pieces.filter(F.col("batch") == batch).collect()
        if not own:
            continue
        wanted = Wanted(own, window)
        terms = small_frame(spark, [(t,) for t in wanted.terms], "term string")
        counts = index.select("term", "n").join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")).collect()
        wanted.rarest_first({r["term"]: r["n"] for r in counts})
        used = small_frame(spark, [("",), *((t,) for t in wanted.terms)], "term string")
        lists = index.select("block", "term", "n", "places", "starts", "sizes").join(F.broadcast(used), "term", "left_semi")
        found.append(lists.groupBy("block").applyInPandas(matcher(wanted, slack), MATCHES))
    if not found:
        return spark.createDataFrame([], MATCHES)
    if len(found) == 1:
        return found[0]
    several = reduce(DataFrame.unionAll, found).groupBy("block", "place")
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return several.agg(F.array_distinct(flat("classes")).alias("classes"), flat("firsts"), flat("lasts")).mapInPandas(merge_spans, MATCHES)


def merge_spans(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose spans neither overlap nor touch, in order: what several batches found in a document may do both."""
    for batch in batches:
        firsts, lasts = [], []
        for first, last in zip(batch["firsts"], batch["lasts"]):
            order = np.argsort(first, kind="stable")
            first, reach = first[order], np.maximum.accumulate(last[order])
            begins = np.concatenate([[True], first[1:] > reach[:-1] + 1])
            firsts.append(first[begins])
            lasts.append(reach[np.concatenate([begins[1:], [True]])])
        yield batch.assign(firsts=firsts, lasts=lasts)


def contamination(
    documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, slack: int = 0,
    id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """A row for each document: id, n_words, n_hit, n_items, items, items_sha256, contaminated, spans (of matched words, from 0).

    Words are runs of digits, letters a-z (A-Z in lower case) and characters beyond ASCII. A document's word is hit inside any
    match of a window of consecutive words of an item; shorter items are one window. Null and empty texts have no words; an item
    without words matches nothing. Items of a null identifier count for hit words but are not named, and repeated identifiers are
    named once. Repeated rows are documents of their own; other columns are not read, so names cannot clash. Without
    documents there are no rows, without items no hits.
    """
    index = build_index(documents, id, text)
    pieces, items = phrases(benchmark, window, item_id, item_text)
    found = cut_lineage(find_phrases(index, pieces, window, slack).withColumn("set", F.md5(F.concat_ws(" ", F.array_sort("classes")))))
    # documents with the same items share one digest
    sets = found.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("class"))
    names = sets.join(items, "class").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    spans = F.arrays_zip(F.col("firsts").alias("first"), F.col("lasts").alias("last"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, span: n + span["last"] - span["first"] + 1)
    matched = found.withColumn("spans", spans).join(names, "set", "left").select("block", "place", n_hit.alias("n_hit"), "items", "spans")
    listed = index.filter("term = ''").select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "own"))
    rows = listed.select("block", "place", F.col("own")["ids"].alias("__id"), F.col("own")["sizes"].alias("n_words"))
    joined = rows.join(matched, ["block", "place"], "left")
    named = F.coalesce("items", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        F.col("__id").alias(id), "n_words", hit.alias("n_hit"), F.size(named).cast("long").alias("n_items"), named.alias("items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans",
    )


def op11_decontaminate(spark: SparkSession, path: str) -> DataFrame:
    """The benchmark items that every document holds; see :func:`contamination`."""
    documents, benchmark = read(spark, path, "documents"), read(spark, path, "benchmark")
    return contamination(documents, benchmark).drop("items", "spans")


OP11_SQL = rf"""
WITH items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark),
docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
windows AS (SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS k, array_to_string(w[i + 1 : i + least(len(w), {WINDOW})], ' ') AS gram
  FROM items, LATERAL unnest(range(greatest(len(w) - {WINDOW} + 1, 1))) AS u(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT k FROM windows),
grams AS (SELECT doc_id, k, pos, array_to_string(w[pos + 1 : pos + k], ' ') AS gram FROM docs, lengths, LATERAL unnest(range(len(w) - k + 1)) AS u(pos) WHERE len(w) >= k),
hits AS (SELECT doc_id, item_id, pos, k FROM grams JOIN windows USING (k, gram)),
spots AS (SELECT DISTINCT doc_id, pos + j AS spot FROM (SELECT DISTINCT doc_id, pos, k FROM hits), LATERAL unnest(range(k)) AS u(j)),
n_hits AS (SELECT doc_id, count(*) AS n_hit FROM spots GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
