"""Column profiles: a few passes over a table however many columns it has.

1. *Base statistics*: one aggregate per group of like columns, each reading only its own columns, without a shuffle
   beyond one row per task.
2. *Distinct counts*: columns unpivoted to (column, value) and counted in two levels, so map tasks combine repeated
   values first. Long text is represented by its hash.
3. *Quartiles*: bounds come with pass 1; one pass counts at them and one picks the values in between, for all columns at once.
4. *Details*: value frequencies of low-cardinality text, example values of odd entries and outlier counts. Which
   columns need these is known by then, so the query reads only those.

Passes 1 and 2 run side by side. One value per statistic and column, and the bounded details, are all that reaches the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import (
    EMAIL_LOOSE,
    EMAIL_STRICT,
    NUMBER_TEXT,
    any_format_date,
    blank_to_null,
    compact_key,
    is_date,
    is_fractional,
    is_integral,
    is_nested,
    is_numeric,
    is_text,
    looks_like_email,
    quoted,
    safe_date,
    safe_double,
    strip,
    text_of,
)
from plumbline.operators import privacy
from plumbline.plans.parallel import collect_together

# Thresholds of the profile.
DOMINANT_SHARE = 0.8
MAX_EXAMPLES = 5
MAX_CATEGORY_VALUES = 10
MAX_FREQUENCY_SHOWN = 10
FREQUENCY_DISTINCT_LIMIT = 100
FENCE = 1.5
EXAMPLE_CHARS = 30
PLACEHOLDERS = ("***", "N/A", "NA", "NONE", "NULL", "UNKNOWN", "UNSPECIFIED", "-")

QUARTILE_ACCURACY = 10_000
QUARTILE_VALUES = 4_000_000  # rows between two bounds that one task puts in order
EXPRESSIONS_PER_SCAN = 96  # keeps each generated aggregate below Spark's field limit for code generation

COLUMN_PROFILE = (
    "position int, column string, type string, inferred_type string, null_rate double, non_null_count long, "
    "distinct_count long, blank_count long, blank_rate double, min string, max string, mean double, stddev double, "
    "min_length int, max_length int, q25 double, q75 double, sample_values array<string>, "
    "frequency array<struct<value:string,count:long,share:double>>"
)
TABLE_PROFILE = (
    "source_key string, profiled_at timestamp, row_count long, column_count int, finding_count int, "
    "high_finding_count int, privacy_count int"
)
FREQUENCY = "column string, value string, count long, share double"
FINDING = (
    "seq int, severity string, column string, kind string, observed double, baseline double, "
    "examples array<string>, message string"
)


def type_label(dtype: T.DataType) -> str:
    if is_date(dtype):
        return "date/time"
    if is_numeric(dtype):
        return "number"
    return "boolean" if isinstance(dtype, T.BooleanType) else "text"


@dataclass(slots=True)
class Profile:
    """A finished profile. Everything in it is at most a few hundred values per column."""

    row_count: int
    columns: list[dict[str, Any]]
    findings: list[tuple]
    privacy: list[tuple]
    spark: SparkSession
    profiled_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    def columns_frame(self) -> DataFrame:
        names = T.StructType.fromDDL(COLUMN_PROFILE).names
        rows = [tuple(c.get(n) for n in names) for c in self.columns]
        return small_frame(self.spark, rows, COLUMN_PROFILE)

    def frequencies_frame(self) -> DataFrame:
        rows = [(c["column"], f["value"], f["count"], f["share"]) for c in self.columns for f in c.get("frequency") or []]
        return small_frame(self.spark, rows, FREQUENCY)

    def findings_frame(self) -> DataFrame:
        return small_frame(self.spark, self.findings, FINDING)

    def privacy_frame(self) -> DataFrame:
        return small_frame(self.spark, self.privacy, privacy.PRIVACY)

    def table_frame(self, source_key: str) -> DataFrame:
        high = sum(1 for f in self.findings if f[1] == "high")
        row = (source_key, self.profiled_at, self.row_count, len(self.columns), len(self.findings), high, len(self.privacy))
        return small_frame(self.spark, [row], TABLE_PROFILE)

    def snapshot_columns(self, source_key: str) -> DataFrame:
        keyed = F.lit(source_key).alias("source_key"), F.lit(self.profiled_at).cast("timestamp").alias("profiled_at")
        return self.columns_frame().select(*keyed, "*")


# --- pass 1: base statistics ------------------------------------------------------------------------------------


def _number_stats(c: Column) -> dict[str, Column]:
    return {
        "non_null": F.count(c),
        "lowest": F.min(c),
        "highest": F.max(c),
        "mean": F.avg(c).cast("double"),
        "stddev": F.stddev_samp(c.cast("double")),
    }


def _quartiles(c: Column) -> dict[str, Column]:
    """Values that surround the quartiles: ranks are off by one in QUARTILE_ACCURACY at most."""
    slack = 2 / QUARTILE_ACCURACY
    around = [0.25 - slack, 0.25 + slack, 0.75 - slack, 0.75 + slack]
    return {"around": F.percentile_approx(c.cast("double"), around, QUARTILE_ACCURACY)}


def exact_quartiles(df: DataFrame, around: dict[str, Sequence[float]]) -> dict[str, tuple[float, float]]:
    """The values at ranks n/4 and 3n/4 (rounded up) of each column, given values that surround them.

    All columns and both quartiles are searched for side by side. One pass counts what lies below and at each bound: the ranks
    then say which bound is the answer (so ties are settled here), or between which two values it lies. A second pass counts the
    few values in between one by one and picks the one at the rank, in Spark. Only where more than QUARTILE_VALUES rows lie
    in between (beyond about 10^10 rows) are the bounds narrowed first, all at once, by values that lie strictly inside, so every
    round ends. The driver gets counts and bounds, one row for a column at a time. NaN counts as larger than infinity.
    """
    open_ends = {(name, q): (bounds[2 * q], bounds[2 * q + 1]) for name, bounds in around.items() for q in (0, 1)}
    found: dict[tuple[str, int], float] = {}
    ranks: dict[tuple[str, int], int] = {}
    between: dict[tuple[str, int], tuple[float | None, float | None, int]] = {}
    while open_ends:
        counted = _count_at(df, open_ends)
        wide: dict[tuple[str, int], tuple[float | None, float | None, int, int]] = {}
        for key, (low, high) in open_ends.items():
            n, under_low, upto_low, under_high, upto_high = counted[key]
            rank = ranks.setdefault(key, -(-n * (1, 3)[key[1]] // 4))
            if under_low < rank <= upto_low:
                found[key] = low
            elif under_high < rank <= upto_high:
                found[key] = high
            else:
                part = (None, low, 0, under_low) if rank <= under_low else (low, high, upto_low, under_high) if rank <= under_high else (high, None, upto_high, n)
                between.pop(key, None)
                if part[3] - part[2] > QUARTILE_VALUES:
                    wide[key] = part
                else:
                    between[key] = part[:3]
        open_ends = _narrowed(df, wide, ranks) if wide else {}
    found |= _at_ranks(df, between, ranks) if between else {}
    return {name: (found[name, 0], found[name, 1]) for name in around if (name, 0) in found and (name, 1) in found}


def _number(name: str) -> Column:
    return F.col(quoted(name)).cast("double")


def _inside(c: Column, low: float | None, high: float | None) -> Column:
    above = F.lit(True) if low is None else c > F.lit(low)
    return c.isNotNull() & above & (F.lit(True) if high is None else c < F.lit(high))


def _count_at(df: DataFrame, bounds: dict[tuple[str, int], tuple[float, float]]) -> dict[tuple[str, int], list[int]]:
    """Of each key: the rows, and how many lie below and up to the lower and the upper bound."""
    keys = list(bounds)
    scans = []
    for part in _chunks(keys, EXPRESSIONS_PER_SCAN // 5):
        tests = []
        for key in part:
            c, (low, high) = _number(key[0]), bounds[key]
            tests.append(F.array(F.count(c), *(F.count_if(t) for t in (c < F.lit(low), c <= F.lit(low), c < F.lit(high), c <= F.lit(high)))))
        scans.append(df.agg(*(test.alias(str(i)) for i, test in enumerate(tests))))
    rows = collect_together(scans)
    return dict(zip(keys, (counts for (row,) in rows for counts in row), strict=True))


def _narrowed(df: DataFrame, wide: dict, ranks: dict) -> dict[tuple[str, int], tuple[float, float]]:
    """New bounds, from the values strictly inside the old ones."""
    keys, slack = list(wide), 2 / QUARTILE_ACCURACY
    scans = []
    for part in _chunks(keys, EXPRESSIONS_PER_SCAN // 5):
        sketches = []
        for key in part:
            low, high, before, upto = wide[key]
            share = (ranks[key] - before) / (upto - before)
            at = [min(max(share + s, 0.0), 1.0) for s in (-slack, slack)]
            c = _number(key[0])
            sketches.append(F.percentile_approx(F.when(_inside(c, low, high), c), at, QUARTILE_ACCURACY))
        scans.append(df.agg(*(sketch.alias(str(i)) for i, sketch in enumerate(sketches))))
    return {key: tuple(bounds) for key, bounds in zip(keys, (b for (row,) in collect_together(scans) for b in row), strict=True)}


def _at_ranks(df: DataFrame, between: dict, ranks: dict) -> dict[tuple[str, int], float]:
    """The value at each key's rank among those strictly between its bounds; a row for each key is all that is collected."""
    keys = list(between)
    scans = []
    for part in _chunks(keys, EXPRESSIONS_PER_SCAN):
        entries = []
        for i, key in enumerate(part):
            low, high, before = between[key]
            c = _number(key[0])
            entries.append(F.when(_inside(c, low, high), F.struct(F.lit(i).alias("i"), F.lit(ranks[key] - before).cast("long").alias("rank"), c.alias("value"))))
        counted = df.select(F.inline(F.array_compact(F.array(*entries)))).groupBy("i", "rank", "value").agg(F.count(F.lit(1)).alias("n"))
        upto = counted.withColumn("upto", F.sum("n").over(Window.partitionBy("i").orderBy("value")))
        scans.append(upto.filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank"))).select("i", "value"))
    found = {}
    for part, rows in zip(_chunks(keys, EXPRESSIONS_PER_SCAN), collect_together(scans), strict=True):
        found |= {part[r["i"]]: r["value"] for r in rows}
    return found


def _prepare_text(c: Column, i: int, database_text: bool) -> dict[str, Column]:
    """What several statistics of a text column share, worked out once per value."""
    if database_text:
        text = strip(c)
        number, day = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double")), any_format_date(c)
    else:
        number, day = safe_double(c), safe_date(c, T.StringType())
    return {f"c{i}": c, f"t{i}": F.trim(c), f"n{i}": number, f"d{i}": day}


def _text_stats(i: int, database_text: bool) -> dict[str, Column]:
    c, trimmed, number, day = (F.col(f"{part}{i}") for part in "ctnd")
    filled = F.nullif(trimmed, F.lit(""))
    stats = {
        "non_null": F.count(c),
        "lowest": F.min(filled),
        "highest": F.max(filled),
        "blank": F.count_if(trimmed == ""),
        "min_length": F.min(F.char_length(c)),
        "max_length": F.max(F.char_length(c)),
        "numeric": F.count(number),
        "dates": F.count(day),
        "first_date": F.min(day),
        "last_date": F.max(day),
    }
    if database_text:
        return {**stats, "number_min": F.min(number), "number_max": F.max(number), "number_mean": F.avg(number)}
    return {
        **stats,
        "loose": F.count_if(looks_like_email(c, EMAIL_LOOSE)),
        "strict": F.count_if(looks_like_email(c, EMAIL_STRICT)),
        "signals": F.array(*(F.count_if(matches) for matches in privacy.value_matches(trimmed))),
    }


def _other_stats(c: Column, dtype: T.DataType) -> dict[str, Column]:
    stats = {"non_null": F.count(c)}
    if is_nested(dtype) or isinstance(dtype, T.BinaryType):
        return stats
    return {**stats, "lowest": F.min(c).cast("string"), "highest": F.max(c).cast("string")}


def _scan(df: DataFrame, stats_of: Sequence[tuple[int, dict[str, Column]]]) -> DataFrame:
    """One aggregate, one row; statistics of column 3 are named like ``mean:3``."""
    statistics = [value.alias(f"{name}:{i}") for i, stats in stats_of for name, value in stats.items()]
    return df.agg(F.count(F.lit(1)).alias("rows:0"), *statistics)


def base_scans(df: DataFrame, database_text: bool = False, quartiles_too: bool = True) -> list[DataFrame]:
    """One-row aggregates. Columns are scanned by family, so each scan reads its own columns only; the quantile
    sketches are kept apart because they would move the plain aggregates out of generated code."""
    numbers, quartiles, texts, others = [], [], [], []
    for i, f in enumerate(df.schema.fields):
        c = F.col(quoted(f.name))
        if is_text(f.dataType):
            texts.append((i, f.name))
        elif is_numeric(f.dataType):
            numbers.append((i, _number_stats(c)))
            if quartiles_too:
                quartiles.append((i, _quartiles(c)))
        else:
            others.append((i, _other_stats(c, f.dataType)))
    scans = []
    for stats_of, width in ((quartiles, 1), (numbers, 9), (others, 3)):
        scans += [_scan(df, part) for part in _chunks(stats_of, EXPRESSIONS_PER_SCAN // width)]
    for part in _chunks(texts, EXPRESSIONS_PER_SCAN // 24):
        prepared = [value.alias(name) for i, n in part for name, value in _prepare_text(F.col(quoted(n)), i, database_text).items()]
        scans.append(_scan(df.select(*prepared), [(i, _text_stats(i, database_text)) for i, _ in part]))
    return scans


def _chunks(items: Sequence, size: int) -> list[Sequence]:
    return [items[start : start + size] for start in range(0, len(items), max(1, size))]


# --- pass 2: distinct counts ----------------------------------------------------------------------------------


def _distinct_key(c: Column, dtype: T.DataType) -> tuple[str, Column]:
    """A value as one of three key types, so that like columns share one compact shuffle."""
    if is_integral(dtype):
        return "long", c.cast("long")
    if isinstance(dtype, T.BooleanType):
        return "long", c.cast("int").cast("long")
    if isinstance(dtype, T.DateType):
        return "long", F.unix_date(c).cast("long")
    if isinstance(dtype, T.TimestampType):
        return "long", F.unix_micros(c)
    if is_fractional(dtype):
        return "double", c.cast("double")
    if is_text(dtype) or is_nested(dtype) or isinstance(dtype, T.BinaryType):
        return "text", compact_key(c, dtype)
    return "text", c.cast("string")


def distinct_counts(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``position, distinct_count`` of every column, exact, NULL not counted; optionally per group."""
    families: dict[str, list[Column]] = {}
    for i, f in enumerate(df.schema.fields):
        if f.name in by:
            continue
        family, key = _distinct_key(F.col(quoted(f.name)), f.dataType)
        families.setdefault(family, []).append(F.struct(F.lit(i).alias("position"), key.alias("key")))
    groups = [F.col(quoted(name)) for name in by]
    counted = [
        df.select(*groups, F.inline(F.array(*structs)))
        .filter(F.col("key").isNotNull())
        .groupBy(*by, "position", "key")
        .agg(F.lit(1).alias("one"))
        .groupBy(*by, "position")
        .agg(F.count(F.lit(1)).alias("distinct_count"))
        for structs in families.values()
    ]
    return reduce(DataFrame.unionByName, counted)


# --- pass 3: details -------------------------------------------------------------------------------------------

def _display(c: Column) -> Column:
    short = F.concat(F.substring(c, 1, EXAMPLE_CHARS - 3), F.lit("..."))
    return F.when(F.char_length(c) > EXAMPLE_CHARS, short).otherwise(c)


def _unpivot(df: DataFrame, entries: Sequence[tuple[int, str, Column | None, Column]]) -> DataFrame:
    """Entries (position, kind, condition, value) as rows, counted per distinct value."""
    structs = []
    for position, kind, condition, value in entries:
        row = F.struct(F.lit(position).alias("position"), F.lit(kind).alias("kind"), value.alias("value"))
        structs.append(row if condition is None else F.when(condition, row))
    rows = df.select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select("e.*")
    return rows.groupBy("position", "kind", "value").agg(F.count(F.lit(1)).alias("count"))


def details(
    df: DataFrame,
    frequencies: Sequence[tuple[int, str, Column | None, Column]],
    examples: Sequence[tuple[int, str, Column | None, Column]],
    outliers: Sequence[tuple[int, Column]],
) -> tuple[list[DataFrame], list[DataFrame]]:
    """Value frames (``position, kind, value, count``) and one-row frames of outlier counts.

    Odd values are made distinct before the few smallest are taken, and cut for display only then.
    """
    values = [_unpivot(df, frequencies)] if frequencies else []
    if examples:
        smallest = Window.partitionBy("position", "kind").orderBy("value")
        values.append(
            _unpivot(df, examples)
            .withColumn("__n", F.row_number().over(smallest))
            .filter(F.col("__n") <= MAX_EXAMPLES)
            .withColumn("value", _display(F.col("value")))
            .drop("__n")
        )
    counts = [
        df.agg(*(F.count_if(condition).alias(str(i)) for i, condition in part))
        for part in _chunks(outliers, EXPRESSIONS_PER_SCAN)
    ]
    return values, counts


# --- the profile ------------------------------------------------------------------------------------------------


def _collected(fields: Sequence[T.StructField], scans: Iterable[list]) -> list[dict[str, Any]]:
    found: list[dict[str, Any]] = [{"distinct": 0} for _ in fields]
    for (row,) in scans:
        for name, value in row.asDict().items():
            statistic, i = name.split(":")
            found[int(i)][statistic] = value
    return found


def privacy_review(df: DataFrame) -> DataFrame:
    """The privacy findings of a table alone: one pass over its text columns, without distinct counts, quartiles or details."""
    fields = df.schema.fields
    texts = [f for f in fields if is_text(f.dataType)]
    found = _collected(texts, collect_together(base_scans(df.select(*(quoted(f.name) for f in texts))))) if texts else []
    labels = {f.name: _text_label(row, 0, True) for f, row in zip(texts, found, strict=True) if row["non_null"]}
    values = [finding for f, row in zip(texts, found, strict=True) for finding in privacy.value_findings(f.name, row["signals"])]
    rows = privacy.review([(f.name, labels.get(f.name, type_label(f.dataType))) for f in fields], values)
    return small_frame(df.sparkSession, rows, privacy.PRIVACY)


def profile(df: DataFrame, *, database_text: bool = False, quartiles: bool = True) -> Profile:
    """Profile every column. ``database_text`` selects the variant for database sources: more date layouts and
    numeric-text statistics, but no e-mail, category or value-shape checks. Without ``quartiles`` there are no q25, q75 and
    outlier findings, and their passes are saved; suggestions, drift and frequencies need none."""
    spark, fields = df.sparkSession, df.schema.fields
    *scans, distinct = collect_together([*base_scans(df, database_text, quartiles), distinct_counts(df)])
    found = _collected(fields, scans)
    for row in distinct:  # one row per column
        found[row.position]["distinct"] = row.distinct_count
    surrounded = {f.name: found[i]["around"] for i, f in enumerate(fields) if found[i].get("around")}
    at_ranks = exact_quartiles(df, surrounded)
    for i, f in enumerate(fields):
        if f.name in at_ranks:
            found[i]["quartiles"] = at_ranks[f.name]
    row_count = found[0]["rows"]
    columns = [_summarise_column(i, f, found[i], row_count, database_text) for i, f in enumerate(fields)]

    values, counts = details(df, *_wanted_details(fields, columns, found, database_text))
    collected = collect_together([*values, *counts])
    seen: dict[tuple[int, str], list[tuple[str | None, int]]] = {}
    for row in (row for rows in collected[: len(values)] for row in rows):  # at most ~120 values per column
        seen.setdefault((row.position, row.kind), []).append((row.value, row["count"]))
    for (row,) in collected[len(values) :]:
        seen |= {(int(i), "outlier"): [(None, n)] for i, n in row.asDict().items()}
    for i, c in enumerate(columns):
        _add_values(c, seen, i, row_count)

    values_found = [] if database_text else [
        finding
        for i, c in enumerate(columns)
        if found[i].get("signals")
        for finding in privacy.value_findings(c["column"], found[i]["signals"])
    ]
    reviewed = privacy.review([(c["column"], c["inferred_type"]) for c in columns], values_found)
    return Profile(row_count, columns, _findings(columns, found, seen, database_text), reviewed, spark)


def _plain(value: Any) -> str | None:
    return None if value is None else repr(value) if isinstance(value, float) else str(value)


def _summarise_column(i: int, f: T.StructField, found: dict[str, Any], n: int, database_text: bool) -> dict[str, Any]:
    non_null, distinct = found["non_null"], found["distinct"]
    c: dict[str, Any] = {
        "position": i,
        "column": f.name,
        "type": f.dataType.simpleString(),
        "inferred_type": type_label(f.dataType),
        "null_rate": round(1 - non_null / n, 6) if n else 0.0,
        "non_null_count": non_null,
        "distinct_count": distinct,
        "min": _plain(found.get("lowest")),
        "max": _plain(found.get("highest")),
        "mean": found.get("mean"),
        "stddev": found.get("stddev"),
    }
    if found.get("quartiles"):
        c["q25"], c["q75"] = found["quartiles"]
    if not is_text(f.dataType) or (not non_null and not database_text):
        return c
    c["blank_count"] = found["blank"]
    c["blank_rate"] = round(found["blank"] / n, 6) if n else 0.0
    if not non_null:
        return c
    if not database_text:
        c |= {"min_length": found["min_length"], "max_length": found["max_length"]}
    c["inferred_type"] = label = _text_label(found, distinct, database_text)
    if label == "date/time":
        c |= {"min": str(found["first_date"]), "max": str(found["last_date"])}
    elif label == "numeric text" and database_text:
        c |= {"min": _plain(found["number_min"]), "max": _plain(found["number_max"]), "mean": found["number_mean"]}
    return c


def _text_label(found: dict[str, Any], distinct: int, database_text: bool) -> str:
    """What a text column mostly holds. The first label whose share is dominant wins."""
    shares = {"date/time": found["dates"], "email": found.get("loose", 0), "numeric text": found["numeric"]}
    for label, count in shares.items():
        if count / found["non_null"] >= DOMINANT_SHARE:
            return label
    return "category" if distinct <= MAX_CATEGORY_VALUES and not database_text else "text"


def odd_kinds(found: dict[str, Any]) -> list[tuple[str, int]]:
    """Which kinds of odd text a column contains, with counts."""
    non_null, loose, numeric = found["non_null"], found["loose"], found["numeric"]
    if loose / non_null >= DOMINANT_SHARE:
        kinds = [("malformed_email", loose - found["strict"]), ("not_email", non_null - loose)]
        return [(kind, n) for kind, n in kinds if n]
    if 0 < numeric / non_null <= (1 - DOMINANT_SHARE):
        return [("number_in_text", numeric)]
    return [("text_in_numbers", non_null - numeric)] if DOMINANT_SHARE <= numeric / non_null < 1 else []


def _wanted_details(fields, columns, found, database_text):
    frequencies, examples, outliers = [], [], []
    for i, (f, c) in enumerate(zip(fields, columns, strict=True)):
        col, row = F.col(quoted(f.name)), found[i]
        if is_text(f.dataType):
            if 0 < c["distinct_count"] <= FREQUENCY_DISTINCT_LIMIT:
                frequencies.append((i, "frequency", None, blank_to_null(col)))
            if database_text or not c["non_null_count"]:
                continue
            if 0 < c["distinct_count"] <= MAX_CATEGORY_VALUES:
                frequencies.append((i, "sample", col.isNotNull(), col))
            conditions = {
                "malformed_email": looks_like_email(col, EMAIL_LOOSE) & ~col.rlike(EMAIL_STRICT),
                "not_email": ~looks_like_email(col, EMAIL_LOOSE),
                "number_in_text": safe_double(col).isNotNull(),
                "text_in_numbers": col.isNotNull() & safe_double(col).isNull(),
            }
            examples += [(i, kind, conditions[kind], col) for kind, _ in odd_kinds(row)]
        elif row.get("quartiles") and not database_text:
            low, high = fences(*row["quartiles"])
            if high > low:
                beyond = (col < F.lit(low)) | (col > F.lit(high))
                outliers.append((i, beyond))
                examples.append((i, "outlier_example", beyond, text_of(col, f.dataType)))
    return frequencies, examples, outliers


def fences(q25: float, q75: float) -> tuple[float, float]:
    """Outlier fences; equal bounds mean there is no spread to judge by."""
    spread = q75 - q25
    return (q25 - FENCE * spread, q75 + FENCE * spread) if spread > 0 else (0.0, 0.0)


def _add_values(c: dict[str, Any], seen: dict, i: int, row_count: int) -> None:
    if (i, "sample") in seen:
        c["sample_values"] = sorted(value for value, _ in seen[i, "sample"])
    if (i, "frequency") in seen:
        ordered = sorted(seen[i, "frequency"], key=lambda e: (-e[1], e[0] is None, e[0] or ""))
        c["frequency"] = [
            {"value": "(blank)" if v is None else v, "count": n, "share": round(n / row_count, 6)} for v, n in ordered
        ]


def is_placeholder(value: str) -> bool:
    text = value.strip().upper()
    return text in PLACEHOLDERS or "**" in text


def _findings(columns: Iterable[dict[str, Any]], found: dict, seen: dict, database_text: bool) -> list[tuple]:
    rows: list[tuple] = []

    def add(severity: str, c: dict, kind: str, observed: float, baseline: float | None, examples: list[str], text: str):
        shown = f" Examples: {', '.join(examples)}." if examples else ""
        rows.append((len(rows), severity, c["column"], kind, float(observed), baseline, examples, text + shown))

    def examples(i: int, kind: str) -> list[str]:
        return sorted(value for value, _ in seen.get((i, kind), []))

    wording = {
        "malformed_email": "{n} e-mail value(s) have no dot in the domain.",
        "not_email": "{n} value(s) are not e-mail addresses although most of the column is.",
        "number_in_text": "{n} numeric value(s) in a column of text.",
        "text_in_numbers": "{n} value(s) are not numeric although most of the column is.",
    }
    for i, c in enumerate(columns):
        if c.get("blank_count"):
            add("medium", c, "blank", c["blank_count"], None, [], f"{c['blank_count']} value(s) are empty or spaces.")
        if "loose" in found[i] and c["non_null_count"]:
            for kind, n in odd_kinds(found[i]):
                add("medium", c, kind, n, None, examples(i, kind), wording[kind].format(n=n))
    for i, c in enumerate(columns):
        beyond = sum(n for _, n in seen.get((i, "outlier"), []))
        if beyond:
            low, high = fences(c["q25"], c["q75"])
            text = f"{beyond} value(s) lie outside {low:.4g} to {high:.4g}."
            add("low", c, "outlier", beyond, None, examples(i, "outlier_example"), text)
    in_order = sorted(columns, key=lambda c: c["column"]) if database_text else columns
    for c in in_order:
        for entry in (c.get("frequency") or [])[:MAX_FREQUENCY_SHOWN]:
            if is_placeholder(entry["value"]):
                text = f"Placeholder {entry['value']!r} occurs {entry['count']} time(s), {entry['share']:.1%} of rows."
                add("medium", c, "placeholder", entry["count"], entry["share"], [entry["value"]], text)
    return rows


def completeness(columns: DataFrame) -> DataFrame:
    """Missing-or-blank percent of rows and distinct percent of non-null values, per profiled column."""
    missing = (F.coalesce("null_rate", F.lit(0.0)) + F.coalesce("blank_rate", F.lit(0.0))) * 100
    distinct = F.when(F.col("non_null_count") > 0, F.col("distinct_count") / F.col("non_null_count"))
    return columns.select(
        "column",
        F.bround(missing, 1).alias("missing_or_blank_percent"),
        F.bround(distinct * 100, 1).alias("distinct_percent"),
    )


def source_key(connection_id: Column, kind: Column, name: Column, sql: Column) -> Column:
    """The identity of a source over time; a source without a name is known by its SQL."""
    named = F.nullif(strip(F.coalesce(name, F.lit(""))), F.lit(""))
    hashed = F.substring(F.sha1(strip(F.coalesce(sql, F.lit("")))), 1, 12)
    return F.concat_ws(":", connection_id.cast("string"), F.coalesce(kind, F.lit("")), F.coalesce(named, hashed))


def metadata_only(columns: DataFrame, findings: DataFrame, privacy_flags: DataFrame, label: str, row_count: int) -> DataFrame:
    """A profile as JSON without any value from text columns and without finding texts, safe to hand on."""
    shown = F.col("inferred_type").isin("number", "date/time")
    column = F.struct(
        "column", "type", "inferred_type", "null_rate", "distinct_count",
        F.when(shown, F.col("min")).alias("min"), F.when(shown, F.col("max")).alias("max"), "mean",
    )

    def listed(frame: DataFrame, name: str, entry: Column, order: Column) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(order.alias("o"), entry.alias("e"))))
        return frame.agg(F.to_json(F.transform(entries, lambda x: x["e"])).alias("json")).select(F.lit(name).alias("part"), "json")

    parts = [
        listed(columns, "columns", column, F.col("position")),
        listed(findings, "findings", F.struct("severity", "column"), F.col("seq")),
        listed(privacy_flags, "privacy_flags", F.struct("severity", "column", "category"), F.col("seq")),
    ]
    header = small_frame(columns.sparkSession, [("source", json.dumps(label)), ("row_count", str(row_count))], "part string, json string")
    return reduce(DataFrame.unionByName, [header, *parts])


# --- grouped snapshots ------------------------------------------------------------------------------------------


def snapshots_by(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One profile snapshot per combination of ``by`` (a source, a day, a load), all in one query.

    Returns the table snapshots (``by, row_count``) and the column snapshots (``by, column, null_rate,
    distinct_count, mean, stddev``), which is what drift compares.
    """
    by = list(by)
    aggregates, structs = [F.count(F.lit(1)).alias("row_count")], []
    for i, f in enumerate(df.schema.fields):
        if f.name in by:
            continue
        c = F.col(quoted(f.name))
        number = c.cast("double") if is_numeric(f.dataType) else F.lit(None).cast("double")
        aggregates += [F.count(c).alias(f"n{i}"), F.avg(number).alias(f"m{i}"), F.stddev_samp(number).alias(f"s{i}")]
        rate = F.bround(1 - F.col(f"n{i}") / F.col("row_count"), 6)
        structs.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(f.name).alias("column"), rate.alias("null_rate"),
                F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("stddev"),
            )
        )
    stats = df.groupBy(*by).agg(*aggregates)
    columns = (
        stats.select(*by, F.inline(F.array(*structs)))
        .join(distinct_counts(df, by), [*by, "position"], "left")
        .withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
        .drop("position")
    )
    return stats.select(*by, "row_count"), columns
