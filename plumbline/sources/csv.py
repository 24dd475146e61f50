"""CSV files: encoding, delimiter and quoting are found by one distributed look at the lines, then Spark reads them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count
from pathlib import PurePosixPath
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.sources.records import land_records

# Other names for encodings, and the delimiters that are tried.
ENCODING_NAMES = {"utf-8-sig": "utf-8", "cp1252": "latin-1", "windows-1252": "latin-1"}
SPARK_CHARSETS = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}
DELIMITERS = (",", ";", "\t", "|")
#: Types that hold each other's values, narrow first; other differing types are read as text.
WIDER = ("int", "bigint", "double")


@dataclass(frozen=True, slots=True)
class CsvLayout:
    encoding: str
    delimiter: str
    multi_line: bool
    large: bool = False  # larger than one split, so that one task a file would be slow


def detect(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file, in one pass over all lines: ``path``, ``encoding``, ``multi_line`` (a quoted field spans lines), ``delimiter``, ``size``.

    The text reader hands over raw bytes, so the strict UTF-8 test runs on every line in the JVM, split by split,
    with no limit on file size. A file starting with a UTF-16 mark is utf-16; invalid UTF-8 means latin-1.
    """
    raw = F.col("value").cast("binary")
    # Bytes, not characters: other encodings have no characters here.
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(paths)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("size"),
            F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"),
            F.hex(F.substring(raw, 1, 2)).alias("mark"),
            F.is_valid_utf8("value").alias("valid"),
            (quotes % 2 == 1).alias("open_quote"),
            _counts(F.make_valid_utf8("value")).alias("n"),
        )
    )
    found = lines.groupBy("path").agg(
        F.min_by("mark", "at").alias("mark"), F.bool_and("valid").alias("valid"), F.bool_or("open_quote").alias("multi_line"), F.max("size").alias("size"), *_votes()
    )
    encoding = F.when(F.col("mark").isin("FFFE", "FEFF"), "utf-16").when(F.col("valid"), "utf-8").otherwise("latin-1")
    return found.select("path", encoding.alias("encoding"), "multi_line", _winner().alias("delimiter"), "size")


def encodings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Per file: ``path``, ``encoding`` and whether a quoted field spans lines (``multi_line``)."""
    return detect(spark, paths).select("path", "encoding", "multi_line")


def sniff_delimiter(lines: Iterable[str]) -> str:
    """The delimiter that splits every line into the same, largest number of fields; comma when none does."""
    heads = [re.sub(r'"[^"]*"', "", line) for line in lines if line.strip()]
    if not heads:
        return ","

    def vote(delimiter: str) -> tuple[bool, int]:
        counts = [line.count(delimiter) for line in heads]
        return (min(counts) == max(counts) and counts[0] > 0, counts[0])

    best = max(DELIMITERS, key=vote)
    return best if vote(best)[1] > 0 else ","


def _counts(value: Column) -> Column:
    """How often each delimiter stands outside quotes in a line; null for a blank line."""
    plain = F.regexp_replace(value, '"[^"]*"', "")
    each = F.array(*(F.length(plain) - F.length(F.replace(plain, F.lit(d), F.lit(""))) for d in DELIMITERS))
    return F.when(F.trim(plain) != "", each)


def _votes() -> list[Column]:
    """Of a file's lines: the first one's counts, and the least and greatest count of each delimiter."""
    filled = F.when(F.col("n").isNotNull(), F.col("at"))
    return [F.min_by("n", filled).alias("head"), *(f(F.col("n")[i]).alias(f"{f.__name__}_{i}") for i in range(len(DELIMITERS)) for f in (F.min, F.max))]


def _winner() -> Column:
    """The delimiter that :func:`sniff_delimiter` would choose: the even ones first, then the largest number in the first line,
    then the order of DELIMITERS."""
    votes = [
        F.struct(((F.col(f"min_{i}") == F.col(f"max_{i}")) & (F.col(f"min_{i}") > 0)).alias("even"), F.col("head")[i].alias("n"), F.lit(-i).alias("order"))
        for i in range(len(DELIMITERS))
    ]
    best = F.greatest(*votes)
    return F.when(best["n"] > 0, F.element_at(F.array(*(F.lit(d) for d in DELIMITERS)), 1 - best["order"])).otherwise(",")


def _wide_delimiters(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """Per file its delimiter, from lines decoded from a charset whose line ends are wider than a byte."""
    reader = spark.read.option("encoding", charset).option("multiLine", "true")
    # one field a line: no character is a delimiter or a quote
    lines = reader.option("sep", "\u0001").option("quote", "").option("escape", "\u0002").schema("value string").csv(paths)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    counted = lines.select(F.col("_metadata.file_path").alias("path"), at.alias("at"), _counts(F.col("value")).alias("n"))
    return counted.groupBy("path").agg(*_votes()).select("path", _winner().alias("delimiter"))


def layouts(spark: SparkSession, path: str, encoding: str | None = None) -> dict[CsvLayout, list[str]]:
    """The files of one source by the way they must be read: each file has its own encoding, delimiter and line breaks."""
    named = encoding.lower() if encoding and encoding.lower() != "auto" else None
    named = ENCODING_NAMES.get(named, named) if named else None
    split = _split_bytes(spark)
    found = {r.path: r for r in detect(spark, path).collect()}  # a row for each file
    charsets = {file: named or r.encoding for file, r in found.items()}
    wide = [file for file, charset in charsets.items() if charset.startswith("utf-16")]
    delimiters = {file: r.delimiter for file, r in found.items()}
    for charset in {charsets[file] for file in wide}:
        own = _wide_delimiters(spark, [unquote(file) for file in wide if charsets[file] == charset], SPARK_CHARSETS.get(charset, charset))
        delimiters |= {r.path: r.delimiter for r in own.collect()}
    groups: dict[CsvLayout, list[str]] = {}
    for file, r in sorted(found.items()):
        many = bool(r.multi_line) and file not in wide
        how = CsvLayout(charsets[file], delimiters[file], many or file in wide, many and r["size"] > split)
        groups.setdefault(how, []).append(unquote(file))
    return groups


def _split_bytes(spark: SparkSession) -> int:
    """The size of a split as Spark's setting names it."""
    text = spark.conf.get("spark.sql.files.maxPartitionBytes").strip().lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30, "t": 40}
    return int(text[:-1]) << units[text[-1]] if text[-1] in units else int(text)


def layout(spark: SparkSession, path: str, encoding: str | None = None) -> CsvLayout:
    """How to read one file or one folder of like files; of files that differ, the first's (see :func:`layouts`)."""
    return next(iter(layouts(spark, path, encoding)), CsvLayout(encoding or "utf-8", ",", False))


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    *,
    schema: str | None = None,
    header: bool = True,
    known: CsvLayout | None = None,
) -> DataFrame:
    """A CSV file or folder as a DataFrame. Files of one layout are read together, those of several put together by column name.
    For large sources pass ``schema`` and the ``known`` layout, which saves the pass that infers types and the one that looks at
    every line. Files with line breaks in quotes that are larger than a split are cut into records by all tasks and kept as
    Parquet in the shared folder (see :mod:`plumbline.sources.records`); UTF-16 files are read by one task each."""
    groups = {known: [path]} if known else layouts(spark, path, encoding)
    if len(groups) < 2:
        how = next(iter(groups), CsvLayout("utf-8", ",", False))
        return _read(spark, how, [path], schema, header)
    frames = [_read(spark, how, files, schema, header) for how, files in groups.items()]
    if not schema:
        frames = [
            _read(spark, how, files, own, header) if own != _types(frame) else frame
            for (how, files), frame, own in zip(groups.items(), frames, _common_types(frames), strict=True)
        ]
    return reduce(lambda one, other: one.unionByName(other, allowMissingColumns=True), frames)


def _read(spark: SparkSession, how: CsvLayout, paths: list[str], schema: object, header: bool) -> DataFrame:
    if how.large:
        return land_records(spark, paths, how.delimiter, how.encoding, schema, header)
    reader = (
        spark.read.option("header", header)
        .option("sep", how.delimiter)
        .option("encoding", SPARK_CHARSETS.get(how.encoding, how.encoding))
        .option("multiLine", how.multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("recursiveFileLookup", "true")
    )
    return (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(paths)


def _types(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in frame.schema.fields)


def _common_types(frames: list[DataFrame]) -> list[str]:
    """Each frame's schema with the types that hold every frame's values, as inference over all files would choose."""
    seen: dict[str, set[str]] = {}
    for frame in frames:
        for field in frame.schema.fields:
            seen.setdefault(field.name, set()).add(field.dataType.simpleString())
    common = {name: next(iter(types)) if len(types) == 1 else max(types, key=WIDER.index) if types <= set(WIDER) else "string" for name, types in seen.items()}
    return [", ".join(f"`{name.replace('`', '``')}` {common[name]}" for name in frame.columns) for frame in frames]


def schema_frame(df: DataFrame) -> DataFrame:
    """Column names and types of a source, without reading it."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string")


def folder_files(spark: SparkSession, base: str, suffix: str = "csv") -> DataFrame:
    """Every matching file below a folder: full ``path`` and sorted ``relative`` name. No file content is read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*.{suffix}")
        .load(base)
        .select(F.col("path"))
    )
    root = urlsplit(base).path.rstrip("/") + "/"
    local = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    return files.select("path", F.substring_index(local, root, -1).alias("relative")).orderBy("relative")


def folder_tables(spark: SparkSession, base: str, suffix: str = "csv") -> DataFrame:
    """The tables of a folder: ``path`` and ``relative`` name of each, sorted. No file content is read.

    A folder of Parquet files is one table, as is a folder whose CSV files are parts (``part-*``) of one; any other file is a
    table of its own. Part files are put together in Spark, so a row for each table is all that can reach the driver.
    """
    files = folder_files(spark, base, suffix)
    name = F.substring_index("relative", "/", -1)
    inside = F.contains("relative", F.lit("/")) & (F.lit(True) if suffix == "parquet" else F.startswith(name, F.lit("part-")))
    top = F.substring_index("relative", "/", 1) if suffix == "parquet" else F.regexp_replace("relative", r"/[^/]*$", "")
    table = F.when(inside, top).otherwise(F.col("relative"))
    root = F.substring("path", F.lit(1), F.length("path") - F.length("relative"))
    return files.select(F.concat(root, table).alias("path"), table.alias("relative")).distinct().orderBy("relative")


def view_names(paths: Sequence[str]) -> dict[str, str]:
    """View name to path: the last part of the path without its suffix, as an identifier; later ones of a name are numbered."""
    stems = [re.sub(r"\W+", "_", PurePosixPath(unquote(urlsplit(path).path)).stem).strip("_") or "csv" for path in paths]
    stems = [f"t_{stem}" if stem[0].isdigit() else stem for stem in stems]
    taken: set[str] = set()
    for i, stem in enumerate(stems):
        options = (stem if k == 1 else f"{stem}_{k}" for k in count(1))
        stems[i] = next(name for name in options if name not in taken)
        taken.add(stems[i])
    return dict(zip(stems, paths, strict=True))
