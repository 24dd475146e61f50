"""The predecessor of each row in time, without handing a whole long series to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def with_previous(df: DataFrame, series: Sequence[str], time: str, values: Sequence[str], slice_unit: str = "month") -> DataFrame:
    """Add ``prev_<value>`` from the row before in the same series.

    Rows look back within their own calendar slice; the first row of a slice takes the last row of the slice
    before it, found among one summary row per slice. A series holding most of the rows is so spread over its slices.
    """
    row = F.struct(*(F.col(v).alias(v) for v in values))
    sliced = df.withColumn("__slice", F.date_trunc(slice_unit, time)).withColumn("__row", row)
    in_slice = Window.partitionBy(*series, "__slice").orderBy(time)
    over_slices = Window.partitionBy(*series).orderBy("__slice")
    carried = (
        sliced.groupBy(*series, "__slice")
        .agg(F.max_by("__row", time).alias("__last"))
        .withColumn("__carried", F.lag("__last").over(over_slices))
        .drop("__last")
    )
    found = (
        sliced.withColumn("__prev", F.lag("__row").over(in_slice))
        .join(carried, [*series, "__slice"])
        .withColumn("__prev", F.coalesce("__prev", "__carried"))
    )
    return found.select(*df.columns, *(F.col(f"__prev.{v}").alias(f"prev_{v}") for v in values))
