"""BPE encoding and decoding with chunks that a rolling hash cuts, so that shared passages are encoded once."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.common import extended, read
from plumbline.plans.durable import cut_lineage

#: A chunk ends where the hash of the last 8 bytes has its top 10 bits clear: every 1024 bytes on average.
WINDOW = 8
CUT_BITS = 10
#: A chunk is common when it is at least one in so many of all chunks, so there are this many common chunks at most.
COMMON_SHARE = 20_000
#: Entries that a task keeps of words, of chunks and of chunk counts; a full store is emptied, which costs time only.
WORDS_KEPT, CHUNKS_KEPT, COUNTS_KEPT = 120_000, 2_000, 20_000
BYTES_AT_ONCE = 1 << 20
ROWS_AT_ONCE = 200
BLANK = re.compile(rb"[\x20\x09-\x0D]")
STOP = re.compile(rb"(?<=[a-z])([.,])(?=[ \n])")
BLANKS = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
#: Marks that stand alone or end a word, but for the apostrophe, which begins tokens of its own.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def ends_of_chunks(data: bytes, since: int, until: int) -> np.ndarray:
    """Ends of chunks in ``data[since:until]``: places that depend on the 8 bytes before them, never inside a character."""
    start = max(since - WINDOW + 1, 0)
    part = np.frombuffer(data, np.uint8, until - start, start)
    h = part.astype(np.uint32)
    h *= np.uint32(0x85EBCA6B)
    factor, width = 0x9E3779B1, 1
    while width < WINDOW:  # each step doubles the bytes that a hash covers
        longer = h.copy()
        longer[width:] += h[:-width] * np.uint32(factor)
        h, factor, width = longer, factor * factor % (1 << 32), 2 * width
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    found = np.flatnonzero(h < np.uint32(1 << (32 - CUT_BITS))) + start + 1
    found = found[(found > since) & (found < until)]
    return found[(np.frombuffer(data, np.uint8)[found] & 0xC0) != 0x80]


def chunk_texts(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The chunks of each text. Short texts are hashed together; a chunk never reaches over the end of its text."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= BYTES_AT_ONCE):
            size += len(texts[upto])
            upto += 1
        data = b"".join(texts[at:upto]) if upto > at + 1 else texts[at]
        ends = [e for since in range(0, len(data), BYTES_AT_ONCE) for e in ends_of_chunks(data, since, min(since + BYTES_AT_ONCE, len(data))).tolist()]
        begin, k = 0, 0
        for text in texts[at:upto]:
            end, out, last = begin + len(text), [], begin
            while k < len(ends) and ends[k] < end:
                # hashes over the first bytes of a text would see the text before it
                if ends[k] >= begin + WINDOW:
                    out.append(data[last : ends[k]])
                    last = ends[k]
                k += 1
            while k < len(ends) and ends[k] == end:
                k += 1
            if last < end:
                out.append(data[last:end])
            yield out
            begin = end
        at = upto


def chunk_key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


#: (number of ids, the ids in decimal joined by a space, the decoded text) of a stretch of text
Coded = tuple[int, str, str]
NOTHING: Coded = (0, "", "")


def joined(parts: list[Coded]) -> Coded:
    if not parts:
        return NOTHING
    counts, ids, texts = zip(*parts, strict=True)
    if 0 in counts:
        return joined([p for p in parts if p[0]])
    return sum(counts), " ".join(ids), " ".join(texts)


def cut_at_blanks(tokenizer_json: str) -> bool:
    """Whether a blank ends every token and letters are lower-cased, so that a text may be encoded stretch by stretch.

    This holds for BPE with word ends behind a normaliser that lower-cases. Other tokenizers (byte-level ones take the blank
    into the next token) encode whole texts instead.
    """
    described = json.loads(tokenizer_json)
    todo, kinds = [described.get("normalizer")], set()
    while todo:
        step = todo.pop() or {}
        kinds.add(step.get("type"))
        todo += step.get("normalizers", [])
    return "Lowercase" in kinds and described.get("model", {}).get("end_of_word_suffix") == "</w>"


class Encoder:
    """Encodes texts by chunks. ``common`` holds chunks encoded beforehand: (head, body, tail) by key."""

    def __init__(self, tokenizer_json: str, common: dict[bytes, tuple] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.ends_word = np.array([n.endswith("</w>") for n in self.names])
        self.by_chunks = cut_at_blanks(tokenizer_json)
        self.common = common or {}
        self.words: dict[bytes, Coded] = {}
        self.seen: dict[bytes, tuple] = {}

    def forget(self) -> None:
        """Empty the stores, so that a worker does not carry them into the tasks of other stages."""
        self.words, self.seen, self.common = {}, {}, {}

    def encode_words(self, words: list[bytes]) -> list[Coded]:
        """Stretches without blanks; those not met before are encoded together."""
        known = self.words
        found = list(map(known.get, words))
        if None in found:
            if len(known) > WORDS_KEPT:
                known.clear()
            missing = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            fresh = dict(zip(missing, self._encode_missing([w.decode() for w in missing]), strict=True))
            known.update(fresh)
            found = [fresh[w] if f is None else f for w, f in zip(words, found, strict=True)]
        return found

    def _encode_missing(self, words: list[str]) -> list[Coded]:
        """Letters and the marks after them are tokens apart, so words with marks share the encoding of their parts."""
        plain, other, split = [], [], {}
        for word in words:
            if word.isalpha():
                plain.append(word)
                continue
            core = word.rstrip(MARKS)
            marks = word[len(core) :]
            if (core.isalpha() or not core) and "<|" not in marks and "|>" not in marks:
                split[word] = core, marks
            else:
                other.append(word)
        pieces = [p for both in split.values() for p in both if p]
        plain = list(dict.fromkeys(plain + pieces))
        coded = dict(zip(plain, self._encode_plain(plain), strict=True)) | dict(zip(other, self._encode_each(other), strict=True))
        coded |= {word: joined([coded[p] for p in both if p]) for word, both in split.items()}
        return [coded[w] for w in words]

    def _encode_plain(self, tokens: list[str]) -> list[Coded]:
        """Single tokens of the pre-tokenizer, joined by spaces: each ends with the one id that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(tokens)], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(tokens) or (len(ends) and ends[-1] != len(ids)):
            return self._encode_each(tokens)
        names, flat, out, at = self.names, ids.tolist(), [], 0
        for end in ends.tolist():
            own = flat[at:end]
            out.append((len(own), " ".join(map(str, own)), " ".join([names[i] for i in own])))
            at = end
        return out

    def _encode_each(self, texts: list[str]) -> list[Coded]:
        out = []
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) if texts else ():
            ids = e.ids
            out.append((len(ids), " ".join(map(str, ids)), self.tokenizer.decode(ids, skip_special_tokens=False)))
        return out

    def encode_chunks(self, new: list[bytes]) -> None:
        """Keep (head, coded body, tail) of each chunk: one may begin and end inside a word, so what lies before the first blank
        and after the last one is left for the joins; a chunk without a blank is kept as None."""
        flat, bodies = [], []
        for chunk in new:
            first = BLANK.search(chunk)
            found = self.common.get(chunk_key(chunk)) if self.common and first else None
            if first is None or found:
                self.seen[chunk] = found
                continue
            begin, last = first.start(), max(map(chunk.rfind, BLANKS))
            words = self._words(chunk[begin:last])
            bodies.append((chunk, begin, last, len(words)))
            flat += words
        coded, at = self.encode_words(flat), 0
        for chunk, begin, last, n in bodies:
            self.seen[chunk] = chunk[:begin], joined(coded[at : at + n]), chunk[last + 1 :]
            at += n

    def _words(self, text: bytes) -> list[bytes]:
        """Lower-cased words; a comma or full stop between a letter and a blank stands by itself, as the pre-tokenizer has it."""
        return text.split() if b"<|" in text else STOP.sub(rb" \1", text.lower()).split()

    def encode(self, texts: list[str]) -> list[Coded]:
        """Count, ids and decoded text of each whole text, as encoding it at once gives them.

        Chunks not met before are encoded, then put together, and each join is repaired: the ends of both chunks are encoded
        again as one stretch, which reaches to the blank on either side. A blank ends every token of this tokenizer, so a stretch
        that reaches one on both sides agrees with its neighbours; a join without a blank grows by the next chunk until it has one.
        With a tokenizer whose tokens reach over blanks (see :func:`cut_at_blanks`) each text is encoded at once.
        """
        if not self.by_chunks:
            return self._encode_each(texts)
        own = list(chunk_texts([t.encode() for t in texts]))
        if len(self.seen) > CHUNKS_KEPT:
            self.seen.clear()
        self.encode_chunks(list(dict.fromkeys(c for cs in own for c in cs if c not in self.seen)))
        stretches: list[bytes] = []
        plans: list[list[Coded | None]] = []  # None: the next stretch
        for cs in own:
            plan: list[Coded | None] = []
            open_end = b""
            for chunk in cs:
                coded = self.seen[chunk]
                if coded is None:
                    open_end += chunk
                    continue
                if open_end or coded[0]:
                    stretches.append(open_end + coded[0])
                    plan.append(None)
                plan.append(coded[1])
                open_end = coded[2]
            if open_end:
                stretches.append(open_end)
                plan.append(None)
            plans.append(plan)
        repaired = iter(self.encode_words(stretches))
        return [joined([next(repaired) if p is None else p for p in plan]) for plan in plans]


ENCODERS: dict[str, Encoder] = {}


def encoder_for(tokenizer_json: str, common: dict[bytes, tuple]) -> Encoder:
    """One encoder for each Python worker: the tokenizer is read once, its stores serve one task."""
    name = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if name not in ENCODERS:
        ENCODERS.clear()
        ENCODERS[name] = Encoder(tokenizer_json)
    ENCODERS[name].common = common
    return ENCODERS[name]


def common_chunks(documents: DataFrame, text: str, tokenizer_json: str) -> dict[bytes, tuple]:
    """The common chunks of all documents, each encoded once.

    Chunks are counted by their keys over the whole table; one is common if it makes up 1/20,000 of all, which bounds their
    number whatever the size. A task hands on the texts of chunks that it met more than once, and of those only the common
    ones are gathered.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[bytes, int] = {}

        def flush() -> pd.DataFrame:
            keys = [int.from_bytes(chunk_key(c)[:8], "little", signed=True) for c in counts]
            out = pd.DataFrame({"key": keys, "n": list(counts.values()), "chunk": [c if n > 1 else None for c, n in counts.items()]})
            counts.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                for own in chunk_texts([(t or "").encode() for t in batch[text].iloc[at : at + ROWS_AT_ONCE]]):
                    for chunk in own:
                        counts[chunk] = counts.get(chunk, 0) + 1
                if len(counts) > COUNTS_KEPT:
                    yield flush()
        if counts:
            yield flush()

    seen = cut_lineage(documents.select(text).mapInPandas(count, "key bigint, n bigint, chunk binary"))
    counted = seen.groupBy("key").agg(F.sum("n").alias("n"))
    total = seen.agg(F.sum("n")).first()[0] or 0
    common = counted.filter((F.col("n") * COMMON_SHARE >= total) & (F.col("n") > 1)).select("key")
    texts = seen.filter("chunk IS NOT NULL").join(F.broadcast(common), "key").select("chunk").distinct()

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(tokenizer_json)
        for batch in batches:
            encoder.encode_chunks(list(batch["chunk"]))
            rows = [(chunk_key(c), *coded) for c, coded in encoder.seen.items() if coded is not None]
            encoder.seen.clear()
            yield pd.DataFrame([(k, h, *b, t) for k, h, b, t in rows], columns=["key", "head", "n", "ids", "decoded", "tail"])

    coded = texts.mapInPandas(encode, "key binary, head binary, n int, ids string, decoded string, tail binary")
    return {bytes(r["key"]): (bytes(r["head"]), (r["n"], r["ids"], r["decoded"]), bytes(r["tail"])) for r in coded.collect()}


def encode_documents(documents: DataFrame, tokenizer: str, text: str = "text", column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``documents`` with the ids of their whole texts as an array, and the decoded texts.

    ``tokenizer`` is the path of a tokenizer file, which only the driver opens. Null and empty texts have no ids and decode to
    empty text; repeated rows get equal ids; columns of the input that clash with the results are replaced.
    """

    def shape(coded: list[Coded]) -> dict[str, list]:
        ids = [np.array(c[1].split(" "), np.int32) if c[0] else np.empty(0, np.int32) for c in coded]
        return {column: ids, decoded: [c[2] for c in coded]}

    kept = [c for c in documents.columns if c not in (column, decoded)]
    return _encoded(documents, kept, tokenizer, text, f"`{column}` array<int>, `{decoded}` string", shape)


def decode_documents(documents: DataFrame, tokenizer: str, column: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``documents`` with the text that the tokenizer makes of each row's ids, special tokens included.

    Null ids, and ids that are null themselves, decode to nothing; a column of the result's name is replaced.
    """
    with open(tokenizer, encoding="utf-8") as file:
        tokenizer_json = file.read()
    kept = [c for c in documents.columns if c != decoded]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = encoder_for(tokenizer_json, {}).tokenizer
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.iloc[at : at + ROWS_AT_ONCE]
                ids = [[] if own is None else [int(i) for i in own if i is not None and i == i] for own in part["__ids"]]
                yield part[kept].assign(**{decoded: library.decode_batch(ids, skip_special_tokens=False)})

    rows = documents.select(*kept, F.col(column).alias("__ids"))
    return rows.mapInPandas(decode, extended(documents.select(*kept), f"`{decoded}` string"))


def digests(documents: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``documents`` without the text, with n_tokens, ids_sha256 and decoded_sha256; cases as in :func:`encode_documents`."""

    def shape(coded: list[Coded]) -> dict[str, list]:
        sha = lambda value: hashlib.sha256(value.encode()).hexdigest()
        return {"n_tokens": [c[0] for c in coded], "ids_sha256": [sha(c[1]) for c in coded], "decoded_sha256": [sha(c[2]) for c in coded]}

    kept = [c for c in documents.columns if c not in (text, "n_tokens", "ids_sha256", "decoded_sha256")]
    return _encoded(documents, kept, tokenizer, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", shape)


def _encoded(documents: DataFrame, kept: list[str], tokenizer: str, text: str, more: str, shape: Callable[[list[Coded]], dict[str, list]]) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as file:
        tokenizer_json = file.read()
    common = common_chunks(documents, text, tokenizer_json) if cut_at_blanks(tokenizer_json) else {}
    shared = documents.sparkSession.sparkContext.broadcast((tokenizer_json, common))
    rows = documents.select(*kept, F.col(text).alias("__text"))

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_for(*shared.value)
        try:
            for batch in batches:
                for at in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.iloc[at : at + ROWS_AT_ONCE]
                    yield part[kept].assign(**shape(encoder.encode([t or "" for t in part["__text"]])))
        finally:
            encoder.forget()

    return rows.mapInPandas(code, extended(rows.select(*kept), more))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_bpe(spark: SparkSession, path: str) -> DataFrame:
    """Ids and decoded text of every document, as digests; see :func:`encode_documents`."""
    return digests(read(spark, path, "documents").select("doc_id", "text"), tokenizer_path())
