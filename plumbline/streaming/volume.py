"""Windowed trends: rows and rule violations per tumbling event-time window, the same on streams and on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.predicates import failing_predicate
from plumbline.operators.volume import DEFAULT_MAX_COUNT
from plumbline.spec import Rule


def windowed_trend(
    df: DataFrame,
    time_column: str,
    size: str,
    rules: Sequence[Rule] = (),
    *,
    min_count: int = 0,
    max_count: int = DEFAULT_MAX_COUNT,
    lateness: str = "0 seconds",
) -> DataFrame:
    """Per window: row count, failed rows of each row rule as ``failed_<rule id>``, and the row-count status.

    On a stream, a window appears once the watermark has passed its end; later rows for it are dropped and counted
    in the query's progress (``numRowsDroppedByWatermark``).
    """
    checks = [F.count_if(failing_predicate(rule, df)).alias(f"failed_{rule.id}") for rule in rules]
    if isinstance(df.schema[time_column].dataType, T.TimestampNTZType):
        df = df.withColumn(time_column, F.col(time_column).cast("timestamp"))  # watermarks need an instant
    if df.isStreaming:
        df = df.withWatermark(time_column, lateness)
    counted = df.groupBy(F.window(time_column, size)).agg(F.count(F.lit(1)).alias("row_count"), *checks)
    inside = F.col("row_count").between(min_count, max_count)
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "row_count",
        *(f"failed_{rule.id}" for rule in rules),
        F.when(inside, "passed").otherwise("failed").alias("status"),
    )


def start_trend(trend: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Append closed windows to Parquet files."""
    writer = trend.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start(path)
