"""Large CSV files with line breaks in quoted fields, cut into records by all tasks side by side.

Whether a line begins inside a quoted field depends on every quote before it. Each line is therefore a function of two states
(outside, inside); the functions of a split's lines are composed into one, the splits' functions are put in a row, and then each
split knows how it begins. Records that reach over a border leave a piece in each split, and the pieces are put together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.frames import small_frame
from plumbline.plans.durable import scratch

CODECS = {"utf-8": "utf-8", "latin-1": "latin-1"}
#: States while a line is read: outside quotes, inside, and after a quote that may end the field or stand for a quote.
OUTSIDE, INSIDE, ENDING = 0, 1, 2
WHOLE, OPENS, GOES_ON, CLOSES = 0, 1, 2, 3
#: Types tried for a column, with the shape of their values: the narrowest that all values have.
SHAPES = (
    ("int", r"^[+-]?[0-9]{1,10}$"),
    ("bigint", r"^[+-]?[0-9]{1,19}$"),
    ("double", r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^NaN$|^-?Inf$"),
    ("date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
    ("timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"),
    ("boolean", r"^([tT][rR][uU][eE]|[fF][aA][lL][sS][eE])$"),
)


def ends_inside(line: Column, delimiter: str, begins_inside: bool) -> Column:
    """Whether a line leaves a quoted field open, if it begins outside or inside of one.

    The line is cut at its quotes. Outside, a quote opens a field only where the field begins. Inside, a quote ends the field
    unless another follows it at once; after the end, text up to the delimiter belongs to the field.
    """
    parts = F.split(line, '"')
    first = parts[0]
    at_field = first.endswith(delimiter) | (first == "")
    start = F.struct(F.lit(INSIDE if begins_inside else OUTSIDE).alias("state"), (F.lit(False) if begins_inside else at_field).alias("field"))

    def quote(seen: Column, part: Column) -> Column:
        state = (
            F.when(seen["state"] == INSIDE, ENDING)
            .when(seen["state"] == ENDING, INSIDE)
            .when(seen["field"], INSIDE)
            .otherwise(OUTSIDE)
        )
        after = F.when((state == ENDING) & (part != ""), OUTSIDE).otherwise(state)
        return F.struct(after.alias("state"), ((after == OUTSIDE) & part.endswith(delimiter)).alias("field"))

    folded = F.aggregate(F.slice(parts, 2, F.size(parts)), start, quote, lambda seen: seen["state"] == INSIDE)
    return F.when(line.contains('"'), folded).otherwise(F.lit(begins_inside))


def _lines(spark: SparkSession, paths: list[str], delimiter: str) -> DataFrame:
    """The lines of files in order: file, split, bytes, and what each makes of the two states."""
    lines = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(paths)
    where = F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split")
    states = (ends_inside(F.col("value"), delimiter, inside).alias(name) for name, inside in (("from_outside", False), ("from_inside", True)))
    return lines.select(*where, F.col("value").cast("binary").alias("value"), *states)


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    file, split = (batch.column(c).to_numpy() for c in ("file", "split"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(split) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        if b > a:
            yield int(file[a]), int(split[a]), batch.slice(a, b - a)


def composed(outside: np.ndarray, inside: np.ndarray) -> tuple[bool, bool]:
    """The states at the end of all lines, from outside and from inside: what the last line says that forgets the state, turned
    over by each line after it that turns the state over."""
    forgets = np.flatnonzero(outside == inside)
    since = forgets[-1] + 1 if len(forgets) else 0
    turned = bool((outside[since:] & ~inside[since:]).sum() % 2)
    if len(forgets):
        return (bool(outside[since - 1]) ^ turned,) * 2
    return turned, not turned


def states_before(begins: bool, outside: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """For each line whether it begins inside a field."""
    forgets, turns = outside == inside, (outside & ~inside).astype(np.int64)
    last = np.maximum.accumulate(np.where(forgets, np.arange(len(outside)), -1))
    flips = np.cumsum(turns)
    base = np.where(last >= 0, outside[last], begins)
    since = flips - np.where(last >= 0, flips[last], 0)
    after = base ^ (since % 2 == 1)
    return np.concatenate([[begins], after[:-1]])


def _split_functions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, split, from_outside, from_inside) of each split."""
    found: dict[tuple[int, int], tuple[bool, bool]] = {}
    for batch in batches:
        for file, split, own in _by_split(batch):
            step = composed(*(own.column(c).to_numpy(zero_copy_only=False) for c in ("from_outside", "from_inside")))
            before = found.get((file, split), (False, True))
            found[file, split] = tuple(step[1] if state else step[0] for state in before)
    keys = list(found)
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)] + [pa.array([found[k][i] for k in keys], pa.bool_()) for i in (0, 1)]
    yield pa.RecordBatch.from_arrays(columns, ["file", "split", "from_outside", "from_inside"])


def _cutter(begin_inside: set[tuple[int, int]], known: set[tuple[int, int]], codec: str) -> Callable:
    """Lines to records. A split's first lines may close a record of the split before, its last may leave one open."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        place, held, number, inside = None, [], 0, False

        def leave(closed: bool) -> None:
            nonlocal held, number
            if held:
                begins = (number == 0 and place in begin_inside)
                kind = (CLOSES if closed else GOES_ON) if begins else (WHOLE if closed else OPENS)
                rows.append((*place, number, kind, b"\n".join(held)))
                number, held = number + 1, []

        def flush() -> pa.RecordBatch:
            nonlocal rows
            texts = [_text(r[4], codec, r[3] in (WHOLE, CLOSES), r[1] == 0 and r[2] == 0) for r in rows]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))]
            rows = []
            return pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], ["file", "split", "number", "kind", "value"])

        for batch in batches:
            for file, split, own in _by_split(batch):
                if place != (file, split):
                    leave(not inside)
                    place, number = (file, split), 0
                    if place not in known:
                        raise RuntimeError("The splits of the files have changed while they were read.")
                    inside = place in begin_inside
                outside, within = (own.column(c).to_numpy(zero_copy_only=False) for c in ("from_outside", "from_inside"))
                before = states_before(inside, outside, within)
                for value, begins in zip(own.column("value").to_pylist(), before.tolist()):
                    if not begins:
                        leave(True)
                    held.append(value)
                inside = bool(within[-1] if before[-1] else outside[-1])
            yield flush()
        leave(not inside)
        yield flush()

    return cut


def _text(value: bytes, codec: str, ends: bool, first: bool) -> str:
    if first and value.startswith(b"\xef\xbb\xbf"):
        value = value[3:]
    return (value[:-1] if ends and value.endswith(b"\r") else value).decode(codec, "replace")


def records(spark: SparkSession, paths: list[str], delimiter: str, encoding: str) -> DataFrame:
    """(first, value): the records of CSV files as text, each once; ``first`` marks a file's first one.

    Two passes over the lines: one composes each split's function, which is one row a split at the driver, the other cuts. Pieces
    at the borders of splits, two for each split at most, are put in order and joined.
    """
    lines = _lines(spark, paths, delimiter)
    functions = lines.drop("value").mapInArrow(_split_functions, "file long, split long, from_outside boolean, from_inside boolean").collect()
    begin_inside, state, file = set(), False, None
    for r in sorted(functions, key=lambda r: (r["file"], r["split"])):
        state = state if r["file"] == file else False
        file = r["file"]
        if state:
            begin_inside.add((file, r["split"]))
        state = r["from_inside"] if state else r["from_outside"]
    known = {(r["file"], r["split"]) for r in functions}
    folder = scratch(spark, "csv-records")
    cut = lines.mapInArrow(_cutter(begin_inside, known, CODECS.get(encoding, encoding)), "file long, split long, number long, kind int, value string")
    cut.withColumn("whole", F.col("kind") == WHOLE).write.partitionBy("whole").option("compression", "zstd").parquet(folder)
    kept = spark.read.schema("file long, split long, number long, kind int, value string, whole boolean").parquet(folder)
    first = (F.col("split") == 0) & (F.col("number") == 0)
    whole = kept.filter("whole").select(first.alias("first"), "value")
    # every piece belongs to the last one before it that opens a record
    pieces = kept.filter("NOT whole")
    borders = small_frame(spark, _owners(pieces), "file long, split long, number long, owner long")
    joined = pieces.join(borders, ["file", "split", "number"]).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("split", "number", "value"))).alias("all")
    )
    text = F.array_join(F.transform("all", lambda p: p["value"]), "\n")
    together = joined.select(((F.col("all")[0]["split"] == 0) & (F.col("all")[0]["number"] == 0)).alias("first"), text.alias("value"))
    return whole.unionByName(together)


def _owners(pieces: DataFrame) -> list[tuple]:
    """The pieces with the number of the piece that opens their record; their texts stay where they are."""
    rows, owner, file = [], -1, None
    for i, r in enumerate(sorted(pieces.select("file", "split", "number", "kind").collect(), key=lambda r: (r["file"], r["split"], r["number"]))):
        if r["kind"] == OPENS or r["file"] != file:
            owner, file = i, r["file"]
        rows.append((r["file"], r["split"], r["number"], owner))
    return rows


def land_records(spark: SparkSession, paths: list[str], delimiter: str, encoding: str, schema: object, header: bool) -> DataFrame:
    """The files as a DataFrame like the reader's: columns by the first record, types as given or found among all values."""
    cut = records(spark, paths, delimiter, encoding).filter(F.trim("value") != "")
    options = {"sep": delimiter, "quote": '"', "escape": '"', "multiLine": "true"}
    head = cut.filter("first").agg(F.min("value")).first()[0] if header else None
    sample = head if header else (cut.select("value").first() or [""])[0]
    names = _fields(spark, sample or "", options)
    body = cut.filter("NOT first").select("value") if header else cut.select("value")
    if schema:
        given = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return body.select(F.from_csv("value", _ddl(given), options).alias("r")).select("r.*")
    columns = T.StructType([T.StructField(name if header else f"_c{i}", T.StringType()) for i, name in enumerate(names)])
    texts = body.select(F.from_csv("value", _ddl(columns), options).alias("r")).select("r.*")
    folder = scratch(spark, "csv-texts")
    texts.write.option("compression", "zstd").parquet(folder)
    return typed(spark.read.schema(columns).parquet(folder))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def _fields(spark: SparkSession, record: str, options: dict[str, str]) -> list[str]:
    """The names in a first record; empty and repeated ones are numbered as the reader does."""
    many = record.count(options["sep"]) + 1
    schema = ", ".join(f"c{i} string" for i in range(many))
    row = small_frame(spark, [(record,)], "value string").select(F.from_csv("value", schema, options).alias("r")).first()["r"]
    # a delimiter in quotes makes no field: names end where the record does
    filled = [row[f"c{i}"] for i in range(many)]
    while len(filled) > 1 and filled[-1] is None and not record.rstrip().endswith(options["sep"]):
        filled.pop()
    lowered = [(name or "").lower() for name in filled]
    return [f"_c{i}" if not name else f"{name}{i}" if lowered.count(name.lower()) > 1 else name for i, name in enumerate(filled)]


def typed(texts: DataFrame) -> DataFrame:
    """Text columns as the narrowest type that all their values have; a column without values stays text."""
    names = [f"`{c.replace('`', '``')}`" for c in texts.columns]
    tests = [
        F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(F.col(c).rlike(shape) & F.col(c).try_cast(kind).isNotNull(), F.lit(False)))).alias(f"{i}:{kind}")
        for i, c in enumerate(names) for kind, shape in SHAPES
    ]
    chunks = [texts.agg(*tests[a : a + 96]).first().asDict() for a in range(0, len(tests), 96)]
    holds = reduce(lambda one, other: {**one, **other}, chunks, {})
    kinds = [next((kind for kind, _ in SHAPES if holds[f"{i}:{kind}"]), "string") for i in range(len(names))]
    return texts.select(*(F.col(c).try_cast(kind).alias(name) for c, kind, name in zip(names, kinds, texts.columns, strict=True)))
