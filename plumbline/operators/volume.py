"""Whole-source rules: row count in range, and age of the newest value. Both are one aggregate each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F, types as T

from plumbline.functions.scalar import is_date, is_text, strip, text_of

DEFAULT_MAX_COUNT = 999_999_999_999
MICROS_PER_DAY = 86_400_000_000

# ISO text: a dashed or compact date, optionally a time with optional minutes, seconds, fraction and zone.
_ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2}(?:\.\d+)?))?)?\s*(Z|[+-]\d{2}(?::?\d{2})?)?)?\z"
_OTHER_LAYOUTS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}\z", "d/M/y"),
    (r"^\d{1,2}-\d{1,2}-\d{4}\z", "d-M-y"),
    (r"^\d{4}/\d{1,2}/\d{1,2}\z", "y/M/d"),
)


def row_count_failed(min_count: int, max_count: int) -> Column:
    """1 when the number of rows is outside the inclusive range, else 0."""
    n = F.count(F.lit(1))
    return F.when((n < min_count) | (n > max_count), 1).otherwise(0).cast("long")


def instant_text(text: Column) -> Column:
    """Text as an instant or NULL; a value without a zone is UTC whatever the session time zone."""

    def part(i: int, default: str) -> Column:
        found = F.regexp_extract(text, _ISO, i)
        return F.when(found == "", F.lit(default)).otherwise(found)

    iso = F.when(
        text.rlike(_ISO),
        F.concat(
            part(1, ""), F.lit("-"), part(2, ""), F.lit("-"), part(3, ""), F.lit(" "),
            part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"), part(7, "Z"),
        ),
    ).try_cast("timestamp")
    others = (
        F.when(text.rlike(shape), _utc_midnight(F.try_to_timestamp(text, F.lit(layout)).cast("date")))
        for shape, layout in _OTHER_LAYOUTS
    )
    return F.coalesce(iso, *others)


def _utc_midnight(day: Column) -> Column:
    return F.concat(day.cast("string"), F.lit(" 00:00:00Z")).try_cast("timestamp")


def latest_instant(c: Column, dtype: T.DataType) -> Column:
    """The largest value of a column as an instant. Text compares as text and is parsed afterwards."""
    top = F.max(c)
    if isinstance(dtype, T.TimestampType):
        return top
    if isinstance(dtype, T.DateType):
        return _utc_midnight(top)
    if is_date(dtype):
        return F.concat(top.cast("string"), F.lit("Z")).try_cast("timestamp")
    text = top if is_text(dtype) else text_of(top, dtype)
    return instant_text(strip(text))


def age_days(latest: Column, as_of: datetime) -> Column:
    days = (F.unix_micros(F.lit(as_of)) - F.unix_micros(latest)) / MICROS_PER_DAY
    return F.bround(F.greatest(days, F.lit(0.0)), 2)


def stale(latest: Column, as_of: datetime, max_age_days: int) -> Column:
    """1 when the newest value is missing, unreadable or strictly older than the allowed age, else 0."""
    age = F.unix_micros(F.lit(as_of)) - F.unix_micros(latest)
    return F.when(latest.isNull() | (age > max_age_days * MICROS_PER_DAY), 1).otherwise(0).cast("long")
