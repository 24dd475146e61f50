"""Joins of source rows to a table of counted keys, safe when a few keys hold most of the rows.

Every rule that must return rows by key first counts its keys, so how often each key occurs on the row side is
known before the join. Keys above ``HOT_ROWS`` are cut into slices: the key table repeats a hot key once per
slice and each row picks a slice from its own contents, so no task receives a whole hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalar import quoted

HOT_ROWS = 1_000_000
# All keys above HOT_ROWS are sliced. A table has no more of them than its rows divided by HOT_ROWS, which bounds the list.

KEY_COUNT = "__n"
SLICE = "__slice"
SLICES = "__slices"


def key_names(count: int) -> list[str]:
    return [f"__k{i}" for i in range(count)]


def with_keys(df: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows that have every key, with the keys as extra columns; a NULL key never matches anything."""
    names = key_names(len(keys))
    present = reduce(Column.__and__, (F.col(name).isNotNull() for name in names))
    return df.withColumns(dict(zip(names, keys, strict=True))).filter(present)


def rows_of_keys(
    df: DataFrame, keys: list[Column], counted: DataFrame, extra: list[str] | None = None, hot_rows: int | None = None
) -> DataFrame:
    """All rows of ``df`` whose key is in ``counted`` (unique keys, ``__n`` = rows of ``df`` with that key).

    ``extra`` names columns of ``counted`` to append to the rows.
    """
    hot_rows = hot_rows or HOT_ROWS
    names = key_names(len(keys))
    hot = (
        counted.filter(F.col(KEY_COUNT) > hot_rows)
        .select(*names, F.ceil(F.col(KEY_COUNT) / hot_rows).cast("int").alias(SLICES))
    )
    slices = F.coalesce(F.col(SLICES), F.lit(1))
    # The slice depends on the row and the task's partition number only, so a rerun task routes rows alike.
    row_slice = F.pmod(F.xxhash64(F.spark_partition_id(), *_hashable(df)), slices).cast("int")
    rows = with_keys(df, keys).join(F.broadcast(hot), names, "left").withColumn(SLICE, row_slice).drop(SLICES)
    sliced = (
        counted.join(F.broadcast(hot), names, "left")
        .withColumn(SLICE, F.explode(F.sequence(F.lit(0), slices - 1)))
        .select(*names, SLICE, *(extra or []))
    )
    how = "inner" if extra else "left_semi"
    return rows.join(sliced, [*names, SLICE], how).select(*_own(df), *(extra or []))


def some_rows_of_keys(df: DataFrame, keys: list[Column], counted: DataFrame, limit: int) -> DataFrame:
    """Rows of the first ``limit`` such keys: at least ``limit`` rows where there are so many, without shuffling any. The keys
    are the first in order, so they are the same in every run and however the rows are partitioned."""
    names = key_names(len(keys))
    chosen = F.broadcast(counted.select(*names).orderBy(*names).limit(limit))
    return with_keys(df, keys).join(chosen, names, "left_semi").select(*_own(df))


def _own(df: DataFrame) -> list[Column]:
    return [F.col(quoted(name)) for name in df.columns]


def _hashable(df: DataFrame) -> list[Column]:
    return [F.col(quoted(f.name)) for f in df.schema.fields if "map" not in f.dataType.simpleString()]
