"""Row rules: each turns into one boolean column that is true on failing rows and false otherwise, never NULL."""

from __future__ import annotations

import math
from datetime import date
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalar import col_of, end_anchored, is_date, safe_date, text_of
from plumbline.spec import Rule, RuleType, require_valid

DEFAULT_MAX_LENGTH = 999_999


def number_setting(value: Any, setting: str) -> int | Decimal:
    """A finite number from a setting; integral values become integers."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        try:
            value = float(str(value).strip())
        except ValueError:
            raise ValueError(f"The {setting} setting must be a number.") from None
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError(f"The {setting} setting must be a finite number.")
        value = int(value) if value.is_integer() else Decimal(repr(value))
    return value if not isinstance(value, int) or abs(value) < 2**63 else Decimal(value)


def _day(bound: Any) -> int | None:
    """A date setting as days since 1970, NULL settings as None."""
    return (date.fromisoformat(str(bound).strip()) - date(1970, 1, 1)).days if bound not in (None, "") else None


def _day_number(day: Column) -> Column:
    return F.unix_date(day).cast("long")


def _outside(number: Column, low: int | None, high: int | None) -> Column:
    """Whether a whole number is outside inclusive bounds. Distance from the middle needs the number only once, where
    two comparisons would parse or format the value twice."""
    if low is not None and high is not None:
        return F.abs(number * 2 - (low + high)) > high - low
    if low is not None:
        return number < low
    return number > high if high is not None else number.isNull()


def _outside_dates(c: Column, low: int | None, high: int | None) -> Column:
    """The same for date and timestamp columns, compared as they are: a bound means midnight."""
    failed = c.isNull()
    failed = failed if low is None else failed | (c < F.date_from_unix_date(F.lit(low)))
    return failed if high is None else failed | (c > F.date_from_unix_date(F.lit(high)))


def failing_predicate(rule: Rule, df: DataFrame) -> Column:
    """The failing-row condition of one row rule over ``df``; raises when the rule cannot apply to it."""
    config = require_valid(rule.rule_type, rule.config)
    c, dtype = col_of(df, config["column"])
    match rule.rule_type:
        case RuleType.NOT_NULL:
            return c.isNull()
        case RuleType.VALUE_RANGE:
            low, high = number_setting(config["min"], "min"), number_setting(config["max"], "max")
            failed = (c < F.lit(low)) | (c > F.lit(high))
        case RuleType.REGEX:
            failed = ~text_of(c, dtype).rlike(end_anchored(str(config["pattern"])))
        case RuleType.LENGTH:
            size = F.char_length(text_of(c, dtype)).cast("long")
            failed = _outside(size, int(config.get("min_length", 0)), int(config.get("max_length", DEFAULT_MAX_LENGTH)))
        case RuleType.ALLOWED_VALUES:
            failed = ~text_of(c, dtype).isin([str(value) for value in config["values"]])
        case RuleType.DATE_VALIDITY:
            low, high = (_day(config.get(key)) for key in ("min_date", "max_date"))
            failed = _outside_dates(c, low, high) if is_date(dtype) else _outside(_day_number(safe_date(c, dtype)), low, high)
            failed = F.coalesce(failed, F.lit(True))  # no value, or no date
        case _:
            raise ValueError(f"{rule.rule_type.value} is not a row rule")
    return F.coalesce(failed, F.lit(False))
