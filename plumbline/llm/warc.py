"""WARC archives with a two-level capture index: blocks of sorted capture lines, and a sparse directory of the blocks."""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.llm.common import join_counted, read, text_of
from plumbline.plans.durable import cut_lineage, scratch

#: Payloads from this size on are stored once; the capture date of every record; lines of an index block.
LEAST_REVISIT = 1_000
CAPTURED = "2024-01-01T00:00:00Z"
BLOCK_LINES = 1_000
RECORD_ID = "urn:x-page:"
END = b"\r\n"


def sort_key(url: Column) -> Column:
    """The URL with its host reversed: ``http://a.example.org/x?y`` is ``org,example,a)/x?y``.

    Scheme, fragment and letter case of the host don't count, blanks and control characters are escaped; null and texts
    without ``://`` sort by themselves.
    """
    rest = F.regexp_extract(url, r"(?s)^[^:]*://(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^#]*)", 1)
    surt = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)
    key = F.when(F.contains(url, F.lit("://")), surt).otherwise(url)
    return F.regexp_replace(F.coalesce(key, F.lit("-")), r"[\x00-\x20\x7F]", "%20")


def captures(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """What is to be written: (key, id, url, payload, digest, size, refers_to).

    A row for each page, with ``refers_to`` null, and a note without payload for each that refers to another. Of payloads with
    equal SHA-1 and length of at least 1000 bytes the one with the largest identifier is written, the others refer to it. Digests
    are counted and joined without the payloads; rows and notes meet when they are dealt out for writing, so payloads are
    shuffled once, however many of them are shared. A payload that a third of the pages share is no hot spot.
    """
    payload = text_of(html).cast("binary")
    digest, size = F.unhex(F.sha1(payload)).alias("digest"), F.octet_length(payload).cast("long").alias("size")
    rows = pages.select(sort_key(F.col(url)).alias("key"), F.col(id).alias("id"), F.col(url).alias("url"), F.col(html).alias("payload"), digest, size)
    slim = rows.select("key", "id", "digest", "size").filter(F.col("size") >= LEAST_REVISIT)
    shared = cut_lineage(slim.groupBy("digest", "size").agg(F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = shared.agg(F.sum("n")).first()[0] or 0
    found = join_counted(slim, shared, ["digest", "size"], "n", total).filter(F.col("id") < F.col("last"))
    notes = cut_lineage(found.select("key", "id", "digest", "size", F.col("last").alias("refers_to")))
    return rows.unionByName(notes, allowMissingColumns=True)


def record(id: str, url: str, payload: bytes, refers_to: str | None) -> bytes:
    """One record: a response with its payload, or a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to else 'response'}",
        f"WARC-Record-ID: <{RECORD_ID}{id}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD_ID}{refers_to}>"]
    return "\r\n".join([*lines, "", ""]).encode() + block + END + END


@dataclass
class Capture:
    """A record as read back. For a revisit, ``payload`` is None and length and digest are those of the payload it refers to."""

    id: str
    kind: str
    refers_to: str | None
    payload: bytes | None
    length: int
    digest: str


def parse_record(data: bytes) -> Capture:
    """Read one record and check its lengths and digests."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != END + END:
        raise ValueError("a record's length is wrong")
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].partition(":")[2]:
        raise ValueError("a record's block differs from its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b": ", 1)[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].partition(":")[2]).hex()
    named = lambda field: field.strip("<>").removeprefix(RECORD_ID)
    refers_to = named(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    if refers_to is None:
        digest = hashlib.sha1(payload).hexdigest()
        if length != len(payload):
            raise ValueError("a payload's length is wrong")
    return Capture(named(fields["WARC-Record-ID"]), fields["WARC-Type"], refers_to, None if refers_to else payload, length, digest)


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the file system that Spark resolves it against, so that every executor opens the same one."""
    spark.range(1, numPartitions=1).write.mode("overwrite").parquet(f"{folder}/_place")
    here = spark.read.parquet(f"{folder}/_place").select("_metadata.file_path").first()[0]
    return unquote(here.rsplit("/_place/", 1)[0])


def place(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a qualified folder (see :func:`qualified`)."""
    return fs.FileSystem.from_uri(quote(folder, safe="/:@"))


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write ``captures`` below ``folder``; returns the top of the index, a row for each shard: first key, last key, names.

    Rows are dealt out by ranges of (key, id), so a host with a third of all pages takes many tasks. Each task writes one
    archive of gzip members, one for each record, and one index shard: lines ``key id offset length`` in order of key and id, in
    gzip blocks of a thousand lines, and a directory with the first key and id and the range of each block. Names hold a number drawn for
    each attempt, and only names that a finished task returned are ever read: a task that is repeated does no harm. The note of
    a capture that refers to another comes just before it.
    """
    refers_to = F.col("refers_to").cast("string").alias("refers_to")
    texts = rows.select("key", F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id"), "url", "payload", "digest", "size", refers_to)
    ordered = texts.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "digest", "size", F.col("refers_to").asc_nulls_last())
    folder = qualified(rows.sparkSession, folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        first = last = note = None
        store, base = place(folder)
        name = uuid.uuid4().hex
        archive = index = None
        at = block_at = 0
        lines: list[str] = []
        directory: list[str] = []

        def close_block() -> int:
            packed = gzip.compress("".join(lines).encode(), 6, mtime=0)
            index.write(packed)
            key, id, *_ = lines[0].split(" ")
            directory.append(f"{key} {id} {block_at} {len(packed)}\n")
            lines.clear()
            return len(packed)

        for batch in batches:
            for key, id, url, payload, digest, size, refers_to in zip(*(batch[c] for c in batch), strict=True):
                if refers_to is not None:
                    note = (key, id, digest, size), refers_to
                    continue
                refers = note[1] if note and note[0] == (key, id, digest, size) else None
                if archive is None:
                    store.create_dir(base, recursive=True)
                    archive, index, first = store.open_output_stream(f"{base}/{name}.warc.gz", compression=None), store.open_output_stream(f"{base}/{name}.cdx.gz", compression=None), (key, id)
                packed = gzip.compress(record(id, url or "", (payload or "").encode(), refers), 6, mtime=0)
                archive.write(packed)
                lines.append(f"{key} {id} {at} {len(packed)}\n")
                at, last = at + len(packed), (key, id)
                if len(lines) == BLOCK_LINES:
                    block_at += close_block()
        if archive is not None:
            if lines:
                close_block()
            archive.close()
            index.close()
            with store.open_output_stream(f"{base}/{name}.idx") as out:
                out.write("".join(directory).encode())
            yield pd.DataFrame([(*first, *last, name)], columns=["first_key", "first_id", "last_key", "last_id", "name"])

    return cut_lineage(ordered.mapInPandas(write, "first_key string, first_id string, last_key string, last_id string, name string"))


def _pair(key: str, id: str) -> tuple[bytes, bytes]:
    return key.encode(), id.encode()


class Index:
    """Looks up captures by key and id: shard by its range, block by binary search in the directory, line in the block by another,
    record by range read. However many captures an URL has, one of them is found in one or two blocks."""

    def __init__(self, folder: str, shards: list[tuple[tuple[bytes, bytes], tuple[bytes, bytes], str]]):
        self.store, self.base = place(folder)
        self.shards = shards  # (first, last, name) in order
        self.starts = [s[0] for s in shards]
        self.name = ""
        self.files: list = []
        self.block: tuple[int, list[list[str]]] = (-1, [])

    def close(self) -> None:
        for file in self.files:
            file.close()
        self.files = []

    def open(self, name: str) -> None:
        if name == self.name:
            return
        self.close()
        self.name, self.block = name, (-1, [])
        with self.store.open_input_stream(f"{self.base}/{name}.idx") as directory:
            entries = [line.split(" ") for line in directory.read().decode().splitlines()]
        self.firsts = [_pair(*e[:2]) for e in entries]
        self.ranges = [(int(e[2]), int(e[3])) for e in entries]
        self.lines = self.store.open_input_file(f"{self.base}/{name}.cdx.gz")
        self.archive = self.store.open_input_file(f"{self.base}/{name}.warc.gz")
        self.files = [self.lines, self.archive]

    def read_block(self, number: int) -> list[list[str]]:
        if self.block[0] != number:
            at, length = self.ranges[number]
            self.lines.seek(at)
            self.block = number, [line.split(" ") for line in gzip.decompress(self.lines.read(length)).decode().splitlines()]
        return self.block[1]

    def find(self, key: str, id: str) -> Iterator[bytes]:
        """The records of a capture; several if it was written several times."""
        wanted = _pair(key, id)
        at = bisect.bisect_right(self.starts, wanted)
        since = at
        while since and self.shards[since - 1][1] >= wanted:  # a capture that ends one shard and begins the next
            since -= 1
        for _, _, name in self.shards[since:at]:
            self.open(name)
            number = max(bisect.bisect_left(self.firsts, wanted) - 1, 0)
            while number < len(self.firsts) and self.firsts[number] <= wanted:
                lines = self.read_block(number)
                line = bisect.bisect_left(lines, wanted, key=lambda line: _pair(*line[:2]))
                while line < len(lines) and lines[line][:2] == [key, id]:
                    self.archive.seek(int(lines[line][2]))
                    yield zlib.decompress(self.archive.read(int(lines[line][3])), 31)
                    line += 1
                number += 1


def look_up(wanted: DataFrame, folder: str, shards: DataFrame) -> DataFrame:
    """The captures for (key, id) rows, a row for each record: id, payload_bytes, payload_digest, record_type, refers_to.

    Shards number as the tasks that wrote them, so their key ranges go along with each task; queries are sorted by key, so a
    task meets each shard, block and stretch of the archive once.
    """
    top = sorted((_pair(r["first_key"], r["first_id"]), _pair(r["last_key"], r["last_id"]), r["name"]) for r in shards.collect())
    text = F.coalesce(F.col("id").cast("string"), F.lit("-")).alias("id")
    ordered = wanted.select("key", text).distinct().repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    folder = qualified(wanted.sparkSession, folder)

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(folder, top)
        try:
            for batch in batches:
                out = []
                for key, id in zip(batch["key"], batch["id"], strict=True):
                    for data in index.find(key, id):
                        c = parse_record(data)
                        out.append((c.id, c.length, c.digest, c.kind, c.refers_to))
                yield pd.DataFrame(out, columns=["id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        finally:
            index.close()

    return ordered.mapInPandas(fetch, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string")


def archive_round_trip(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages as WARC records below ``folder``, then read each back through the index.

    A row for each page: id, payload_bytes, payload_digest, record_type, refers_to. Null and empty payloads are responses of
    no bytes; null URLs are captures of the key ``-``; a page that comes twice is two records. Identifiers keep their type; an
    empty table gives no rows.
    """
    kind = pages.schema[id].dataType
    own = pages.select(id, url, html)
    shards = write_archives(captures(own, id, url, html), folder)
    found = look_up(own.select(sort_key(F.col(url)).alias("key"), F.col(id).alias("id")), folder, shards)
    named = F.when(F.col("id") != "-", F.col("id")).cast(kind)
    return found.select(named.alias(id), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op6_warc(spark: SparkSession, path: str) -> DataFrame:
    """All pages written to WARC archives in the shared folder and read back; see :func:`archive_round_trip`."""
    return archive_round_trip(read(spark, path, "pages").select("page_id", "url", "html"), scratch(spark, "warc"))


OP6_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
sized AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM sized
"""
