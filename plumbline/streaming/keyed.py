"""Key rules over whole streams: what was seen in earlier micro-batches is kept as state, in RocksDB on the executors.

``start_checks`` gives key rules one micro-batch at a time; here a key repeated days later is found, and a reference that
arrives before the row it points to is not reported.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.functions.scalar import col_of, compact_key, is_integral, normalised_key
from plumbline.plans.skew import KEY_COUNT, key_names, with_keys
from plumbline.sources.stores import append, read

TIME, MICROS, BUCKET, SALT, TARGET = "event_time", "micros", "bucket", "salt", "is_target"
WINDOW_START = "window_start"
SALTS, BUCKETS = 4, 256
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# --- unique keys ------------------------------------------------------------------------------------------------------


def counted_keys(
    stream: DataFrame, columns: Sequence[str], *, time_column: str | None = None, horizon: str | None = None, lateness: str = "0 seconds"
) -> DataFrame:
    """Rows of each key so far. Counting is a streaming aggregate: each task counts its own rows before the shuffle, so a
    key holding a third of the stream is one row per task and batch.

    With a ``horizon`` rows of a key belong together while no two neighbours in time are further apart than that; such a
    group is closed, reported and forgotten once the watermark has passed its end, which bounds the state. Without one,
    keys are never forgotten. A key with a NULL part, and with a horizon a row without a time, takes no part.
    """
    names = key_names(len(columns))
    rows = with_keys(stream, [compact_key(*col_of(stream, name)) for name in columns])
    if horizon is None:
        return rows.groupBy(*names).agg(F.count(F.lit(1)).alias(KEY_COUNT)).withColumn(WINDOW_START, F.lit(None).cast("timestamp"))
    if time_column is None:
        raise ValueError("A horizon needs a time column.")
    rows = rows.select(*names, _instant(rows, time_column).alias(TIME)).filter(F.col(TIME).isNotNull()).withWatermark(TIME, lateness)
    grouped = rows.groupBy(F.session_window(TIME, horizon), *names).agg(F.count(F.lit(1)).alias(KEY_COUNT))
    return grouped.select(*names, KEY_COUNT, F.col("session_window.start").alias(WINDOW_START))


def start_unique(
    stream: DataFrame,
    columns: Sequence[str],
    path: str,
    checkpoint: str,
    *,
    name: str,
    time_column: str | None = None,
    horizon: str | None = None,
    lateness: str = "0 seconds",
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Record keys that occur more than once; a batch that is retried replaces what it wrote before.

    Without a horizon a key is recorded in each batch that adds to it, with its count so far; with one, once its group is
    closed. ``repeated_keys`` reads either.
    """
    counted = counted_keys(stream, columns, time_column=time_column, horizon=horizon, lateness=lateness)

    def record(batch: DataFrame, batch_id: int) -> None:
        append(batch.filter(F.col(KEY_COUNT) > 1), path, f"{name}-{batch_id:012d}")

    writer = counted.writeStream.queryName(name).outputMode("update" if horizon is None else "append").foreachBatch(record)
    return _start(writer.option("checkpointLocation", checkpoint), stream.sparkSession, available_now, interval)


def repeated_keys(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Each repeated key (and group in time) once: its columns, ``failed_count`` rows and ``window_start``."""
    names = key_names(len(columns))
    latest = read(spark, path).groupBy(*names, WINDOW_START).agg(F.max(KEY_COUNT).alias("failed_count"))
    return latest.select(*(F.col(k).alias(c) for k, c in zip(names, columns, strict=True)), WINDOW_START, "failed_count")


# --- references -------------------------------------------------------------------------------------------------------

MISSING = "key string, due long, failed_count long"
WAITING = "known map<string,long>, waiting map<string,array<long>>"


def missing_references(
    source: DataFrame, source_key: str, source_time: str, target: DataFrame, target_key: str, target_time: str, *,
    wait: str, lateness: str = "0 seconds", salts: int = SALTS, buckets: int = BUCKETS,
) -> DataFrame:
    """Rows of one stream whose key no row of the other has had by ``wait`` after them: key, when they were due, and how many.

    Targets count from the beginning, so a key that was there once stays known; its state is one number. Waiting rows are
    decided by slots of their due time (a slot is as long as ``wait``) when the watermark passes the slot: then every target
    that could still help has come. Keys are dealt over ``buckets`` by their hash, and a bucket's keys are handled together:
    a batch calls Python once a bucket, not once a key, and reads the state of the buckets it meets. Rows of a key are dealt
    over ``salts`` groups by their time and targets go to all of them, so a key holding a third of the stream is not one
    task's work. A checkpoint keeps the two numbers it began with. Rows without a key or a time take no part. Keys compare
    as stripped text.
    """
    length = int(pd.Timedelta(wait) // pd.Timedelta(microseconds=1))
    if length < 1000:
        raise ValueError("The wait must be a millisecond or longer.")
    known = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    dealt = F.pmod(F.xxhash64(TIME), F.lit(salts)).cast("int")
    rows = _side(source, source_key, source_time, lateness).select("*", dealt.alias(SALT), F.lit(False).alias(TARGET))
    targets = _side(target, target_key, target_time, lateness).select("*", known.alias(SALT), F.lit(True).alias(TARGET))
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")
    grouped = rows.union(targets).withColumn(BUCKET, bucket).groupBy(BUCKET, SALT)
    missing = grouped.applyInPandasWithState(_decide(length), MISSING, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return missing.withColumn("due", F.timestamp_micros("due"))


def start_references(missing: DataFrame, path: str, checkpoint: str, *, available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Append decided rows to Parquet files, each exactly once."""
    writer = missing.writeStream.format("parquet").outputMode("append").option("path", path)
    return _start(writer.option("checkpointLocation", checkpoint), missing.sparkSession, available_now, interval)


def _decide(length: int) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """State of a bucket: the first target of each key, and the times of each key's waiting rows."""
    never = float("inf")

    def decide(group: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, waiting = state.get if state.exists else ({}, {})
        for some in batches:  # one without rows when a slot has ended
            is_target = some[TARGET].to_numpy().astype(bool)
            for key, time in zip(some["key"][is_target], some[MICROS][is_target].tolist(), strict=True):
                if time < known.get(key, never):
                    known[key] = time
            for key, time in zip(some["key"][~is_target], some[MICROS][~is_target].tolist(), strict=True):
                if time + length < known.get(key, never):
                    waiting.setdefault(key, []).append(time)
        watermark = state.getCurrentWatermarkMs()
        failed, still, soonest = Counter(), {}, never
        for key, times in waiting.items():
            first = known.get(key, never)
            for time in times:
                if time + length < first:
                    due = (time // length + 2) * length
                    if due <= watermark * 1000:
                        failed[key, due] += 1
                    else:
                        still.setdefault(key, []).append(time)
                        soonest = min(soonest, due)
        state.update((known, still))
        if still:
            # Goes off once the watermark is later, so a millisecond before the first slot's end, rounded up.
            state.setTimeoutTimestamp(max(-(-soonest // 1000) - 1, watermark + 1))
        if failed:
            yield pd.DataFrame([(*place, count) for place, count in failed.items()], columns=["key", "due", "failed_count"])

    return decide


def _side(df: DataFrame, key: str, time: str, lateness: str) -> DataFrame:
    found, dtype = col_of(df, key)
    text = found.cast("string") if is_integral(dtype) else normalised_key(found, dtype)
    timed = df.select(text.alias("key"), _instant(df, time).alias(TIME)).dropna().withWatermark(TIME, lateness)
    return timed.withColumn(MICROS, F.unix_micros(TIME))  # numbers mean the same in every time zone


def _instant(df: DataFrame, name: str) -> Column:
    return col_of(df, name)[0].cast("timestamp")  # watermarks need an instant


def _start(writer: Any, spark: SparkSession, available_now: bool, interval: str) -> StreamingQuery:
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    with _state_on_disk(spark):
        return writer.start()


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A query takes the session's settings when it starts; the session has its own back afterwards."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)
