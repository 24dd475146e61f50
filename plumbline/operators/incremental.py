"""Profiles that grow with a table: statistics of parts are kept and merged, so each file is read once in its life.

A part is a file, or the rows of any group (a source, a day). Counts of parts add up, extremes are compared, means and squared
deviations are put together around the common mean, and distinct values are HyperLogLog sketches that unite. A month is thus the
union of its days, and a profile of a folder the union of its files; neither reads the data again. A part takes one row for each
column, and a sketch at most a few kilobytes, so the statistics stay far below a thousandth of files of usual size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions.scalar import is_nested, is_numeric, is_text, quoted
from plumbline.operators.profile import EXPRESSIONS_PER_SCAN, _chunks, _distinct_key
from plumbline.sources import stores

#: Binary logarithm of a sketch's registers: the standard error is 1.04 / sqrt(2 ** 12), 1.6 %.
PRECISION = 12
FILE = ("__file", "__size", "__modified")
#: What is kept of a part and column, with its type; ``squares`` are summed around the mean.
KEPT = {
    "rows": "long", "non_null": "long", "blank": "long", "low_number": "double", "high_number": "double", "low_text": "string",
    "high_text": "string", "min_length": "int", "max_length": "int", "numbers": "long", "mean": "double", "squares": "double",
    "sketch": "binary",
}


def standard_error(precision: int = PRECISION) -> float:
    return 1.04 / 2 ** (precision / 2)


def _mergeable(c: Column, dtype: T.DataType, precision: int) -> dict[str, Column]:
    """What is kept of one column, in the order of ``KEPT`` behind ``rows``; what a type does not have is NULL."""
    none = F.lit(None)
    number = c.cast("double") if is_numeric(dtype) else none.cast("double")
    text = c if is_text(dtype) else none.cast("string")
    if is_text(dtype):
        low, high = (of(F.nullif(F.trim(c), F.lit(""))) for of in (F.min, F.max))
    elif is_numeric(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
        low = high = none
    else:
        low, high = F.min(c), F.max(c)
    family, key = _distinct_key(c, dtype)
    if family != "long":  # sketches take no fractions and pass over empty text
        key = F.when(c.isNotNull(), F.xxhash64(key + 0.0 if family == "double" else key))
    return {
        "non_null": F.count(c),
        "blank": F.count_if(F.trim(text) == "") if is_text(dtype) else none.cast("long"),
        "low_number": F.min(number),
        "high_number": F.max(number),
        "low_text": low.cast("string"),
        "high_text": high.cast("string"),
        "min_length": F.min(F.char_length(text)),
        "max_length": F.max(F.char_length(text)),
        "numbers": F.count(number),
        "mean": F.avg(number),
        "squares": F.var_pop(number) * F.count(number),
        "sketch": F.hll_sketch_agg(key, precision),
    }


def part_statistics(df: DataFrame, by: Sequence[str], precision: int = PRECISION) -> DataFrame:
    """``by, column`` and ``KEPT``: one row for each part and column, and one with a NULL column that counts the part's rows.

    Map tasks aggregate first, so a part that holds a third of the rows is one row for each task. Each scan reads the columns it
    needs. Numbers are kept as doubles, dates and times as ISO text. A table without rows has no parts; repeated rows count as
    often as they come. Names of ``by`` may not be names of the result; columns of ``df`` may.
    """
    by = list(by)
    if clashing := {*by} & {"column", *KEPT}:
        raise ValueError(f"Parts cannot be named by {sorted(clashing)}.")
    keys = [F.col(quoted(name)) for name in by]
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in KEPT.items() if name != "rows"]
    parts = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).select(*keys, F.lit(None).cast("string").alias("column"), "rows", *nothing)]
    for fields in _chunks([f for f in df.schema.fields if f.name not in by], EXPRESSIONS_PER_SCAN // len(KEPT)):
        aggregates, structs = [F.count(F.lit(1)).alias(":rows")], []
        for i, f in enumerate(fields):
            kept = _mergeable(F.col(quoted(f.name)), f.dataType, precision)
            aggregates += [value.alias(f":{name}:{i}") for name, value in kept.items()]
            named = [F.col(f"`:{name}:{i}`").cast(KEPT[name]).alias(name) for name in kept]
            structs.append(F.struct(F.lit(f.name).alias("column"), F.col("`:rows`").alias("rows"), *named))
        parts.append(df.groupBy(*keys).agg(*aggregates).select(*keys, F.inline(F.array(*structs))))
    return reduce(DataFrame.unionByName, parts)


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on keys where NULL equals NULL, with the keys of the left side."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    on = reduce(Column.__and__, (F.col(quoted(k)).eqNullSafe(F.col(quoted(f"__right_{k}"))) for k in keys))
    return left.join(renamed, on, how).drop(*(f"__right_{k}" for k in keys))


def combine(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Parts united to larger ones, of the same form: days to a month, files to a table. ``by`` are columns of ``parts``.

    Deviations are summed around the mean of the larger part, so nothing cancels. Sketches of different precision unite to the
    coarser one.
    """
    groups = [*by, "column"]
    numbers = F.sum("numbers")
    whole = parts.groupBy(*groups).agg(
        *(F.sum(name).alias(name) for name in ("rows", "non_null", "blank")),
        *(F.min(name).alias(name) for name in ("low_number", "low_text", "min_length")),
        *(F.max(name).alias(name) for name in ("high_number", "high_text", "max_length")),
        numbers.alias("numbers"),
        F.try_divide(F.sum(F.col("mean") * F.col("numbers")), numbers).alias("mean"),
        F.hll_union_agg("sketch", True).alias("sketch"),
    )
    off = F.col("mean") - F.col("centre")
    around = whole.select(*groups, F.col("mean").alias("centre"))
    squares = (
        _matched(parts.filter("numbers > 0").select(*groups, "numbers", "mean", "squares"), around, groups, "inner")
        .groupBy(*groups)
        .agg(F.sum(F.col("squares") + F.col("numbers") * off * off).alias("squares"))
    )
    return _matched(whole, squares, groups, "left").select(*groups, *KEPT)


def summarise(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of every part of :func:`combine`: one row for each part and column that any of its rows had.

    Rows of files that lacked a column count as NULL there. The distinct count is an estimate, see :func:`standard_error`.
    """
    total = F.max("rows").over(Window.partitionBy(*by))  # a row for each column by now
    filled = F.coalesce(F.try_divide(F.col("non_null"), F.col("row_count")), F.lit(1.0))
    spread = F.when(F.col("numbers") > 1, F.sqrt(F.col("squares") / (F.col("numbers") - 1)))
    return parts.withColumn("row_count", total).filter(F.col("column").isNotNull()).select(
        *by, "column", "row_count", F.col("non_null").alias("non_null_count"), F.bround(1 - filled, 6).alias("null_rate"),
        F.hll_sketch_estimate("sketch").alias("distinct_estimate"), F.col("blank").alias("blank_count"), "low_number", "high_number",
        "low_text", "high_text", "mean", spread.alias("stddev"), "min_length", "max_length",
    )


# --- folders of files ---------------------------------------------------------------------------------------------


def _identity() -> list[Column]:
    names = ("file_path", "file_size", "file_modification_time")
    return [F.col(f"_metadata.{name}").alias(own) for name, own in zip(names, FILE, strict=True)]


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and identity of the Parquet files below a folder; no file is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return listed.select("path", *_identity())


def _stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return stores.read(spark, store)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def unread_files(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """The files whose path, size and time of change the store does not know yet, as :func:`files_of`."""
    listed, known = files_of(spark, folder), _stored(spark, store)
    new = listed if known is None else listed.join(known.filter("column IS NULL").select(*FILE), list(FILE), "left_anti")
    return new.select("path", *FILE)


def read_files(spark: SparkSession, folder: str, paths: Sequence[str]) -> DataFrame:
    """Files of a folder with its partition columns, and the identity of each row's file."""
    data = spark.read.option("mergeSchema", "true").option("basePath", folder).parquet(*paths)
    return data.select("*", *_identity())


def update_parts(spark: SparkSession, folder: str, store: str, precision: int = PRECISION) -> int:
    """Add the statistics of new and changed files to the store; returns how many files were read.

    The driver holds the paths of new files, as Spark does itself for every table it reads. A file without rows is recorded too,
    so that it is not read again. An update that fails leaves nothing behind; two at once may both record a file, which
    :func:`stored_profile` takes once.
    """
    new = unread_files(spark, folder, store).collect()
    if not new:
        return 0
    batch = uuid.uuid4().hex
    statistics = part_statistics(read_files(spark, folder, [r.path for r in new]), FILE, precision)
    listed = spark.createDataFrame([tuple(r) for r in new], f"path string, {FILE[0]} string, {FILE[1]} long, {FILE[2]} timestamp")
    stores.append(statistics, store, batch)
    empty = listed.select(*FILE).join(spark.read.parquet(f"{store.rstrip('/')}/{stores.BATCH}={batch}"), list(FILE), "left_anti")
    marks = [F.lit(0 if name == "rows" else None).cast(kind).alias(name) for name, kind in KEPT.items()]
    if not empty.isEmpty():
        stores.append(empty.select(*FILE, F.lit(None).cast("string").alias("column"), *marks), store, f"{batch}-empty")
    return len(new)


def stored_profile(spark: SparkSession, folder: str, store: str) -> DataFrame:
    """The profile of the files the folder holds now, from the store alone; files that went or changed no longer count."""
    parts = stores.read(spark, store)
    once = parts.filter("column IS NULL").groupBy(*FILE).agg(F.min(stores.BATCH).alias(stores.BATCH))
    current = once.join(files_of(spark, folder).select(*FILE), list(FILE), "left_semi")
    return summarise(combine(parts.join(current, [*FILE, stores.BATCH], "left_semi")))
