"""Starter rules from a column profile. Observed values become editable settings; nothing is saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.scalar import EMAIL_RULE_PATTERN
from plumbline.operators.profile import DOMINANT_SHARE, MAX_CATEGORY_VALUES

# Names that look like identifiers, and the wording of rule names.
IDENTIFIER_SUFFIXES = ("_id", "_key", "_code", "_number", "_nr", "nummer", "nr", "code", "sleutel")
RULE_NAMES = {
    "not_null": "{column} must not be null",
    "unique": "{column} must be unique",
    "duplicate": "{column} must not contain duplicates",
    "date_validity": "{column} must be a valid date",
    "regex": "{column} must be a valid email",
    "value_range": "{column} must stay within range",
    "allowed_values": "{column} must use allowed values",
    "length": "{column} must have an expected length",
}


def looks_like_identifier(column: Column) -> Column:
    name = F.translate(F.lower(column), "- ", "__")
    test = name == "id"
    for suffix in IDENTIFIER_SUFFIXES:
        test = test | name.endswith(suffix)
    return test


def _with(base: Column, *parts: tuple[str, Column]) -> Column:
    """Settings as JSON: the column plus further members whose values already are JSON."""
    closed = F.to_json(F.struct(base.alias("column")))
    opened = F.substring(closed, F.lit(1), F.char_length(closed) - 1)
    return F.concat(opened, *(x for name, value in parts for x in (F.lit(f',"{name}":'), value)), F.lit("}"))


def suggestions(profile_columns: DataFrame, row_count: Column, limit: int | None = None) -> DataFrame:
    """``rule_type, column, name, config`` for one profiled source, in column order; all of them unless ``limit`` says how many."""
    c, distinct, label = F.col("column"), F.coalesce("distinct_count", F.lit(0)), F.coalesce("inferred_type", F.lit("text"))
    null_rate = F.coalesce("null_rate", F.lit(0.0))
    rows = F.coalesce(row_count, F.lit(0))
    non_null = F.bround(rows * (1 - null_rate)).cast("long")
    complete = (rows > 0) & (null_rate == 0)
    unique = (rows > 1) & (null_rate == 0) & (distinct == rows)
    repeated = (non_null > 1) & (distinct < non_null) & (F.try_divide(distinct, non_null) >= DOMINANT_SHARE)
    lengths = [F.coalesce(F.col(n), F.lit(0)) for n in ("min_length", "max_length")]
    values = F.coalesce("sample_values", F.array().cast("array<string>"))
    columns_json = F.to_json(F.struct(F.array(c).alias("columns")))

    checks: list[tuple[str, Column, Column]] = [
        ("not_null", complete & (F.coalesce("blank_rate", F.lit(0.0)) == 0), _with(c)),
        ("unique", unique, columns_json),
        ("duplicate", ~unique & looks_like_identifier(c) & repeated, columns_json),
        ("date_validity", label == "date/time", _with(c)),
        ("regex", label == "email", F.to_json(F.struct(c.alias("column"), F.lit(EMAIL_RULE_PATTERN).alias("pattern")))),
        (
            "value_range",
            (label == "number") & F.col("min").isNotNull() & F.col("max").isNotNull(),
            _with(c, ("min", F.col("min")), ("max", F.col("max"))),
        ),
        (
            "allowed_values",
            (label == "category")
            & (distinct > 1)
            & (distinct <= MAX_CATEGORY_VALUES)
            & (F.size(values) == distinct)
            & (non_null > 0),
            F.to_json(F.struct(c.alias("column"), values.alias("values"))),
        ),
        (
            "length",
            label.isin("text", "category", "email") & (lengths[0] > 0) & (lengths[1] > 0),
            F.to_json(F.struct(c.alias("column"), lengths[0].alias("min_length"), lengths[1].alias("max_length"))),
        ),
    ]
    offered = [
        F.when(
            condition,
            F.struct(F.lit(i).alias("ordinal"), F.lit(kind).alias("rule_type"), _name(kind, c).alias("name"), config.alias("config")),
        )
        for i, (kind, condition, config) in enumerate(checks)
    ]
    exploded = profile_columns.select("position", "column", F.explode(F.array_compact(F.array(*offered))).alias("s"))
    ordered = exploded.select("position", "column", "s.*").orderBy("position", "ordinal")
    return (ordered if limit is None else ordered.limit(limit)).select("rule_type", "column", "name", "config")


def _name(kind: str, column: Column) -> Column:
    before, after = RULE_NAMES[kind].split("{column}")
    return F.concat(F.lit(before), column, F.lit(after))
