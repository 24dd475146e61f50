"""Drift: every profile snapshot against the one before it, for all sources at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.ordered import with_previous

# When a change becomes a finding.
ROWS_HIGH, ROWS_MEDIUM = 0.30, 0.10
NULLS_HIGH, NULLS_MEDIUM = 0.10, 0.02
NULLS_FLOOR, NULLS_FACTOR = 0.001, 3
DISTINCT_DROP = 0.5
MEAN_STDDEVS = 3.0

KEY = ("source_key", "profiled_at")
FINDING = ("severity", "column", "kind", "observed", "baseline", "message")
# Order of kinds within one report, before the severity sort; columns of a kind follow in name order.
_GROUPS = {"row_count": 0, "column_vanished": 1, "column_appeared": 2}
_PER_COLUMN = {"null_rate": 0, "distinct_count": 1, "mean": 2}


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "medium", 1).otherwise(2)


def _finding(kind: str, severity: Column, observed: Column, baseline: Column, message: Column, column: Column | None = None):
    """A finding struct; NULL when there is no severity."""
    entry = F.struct(
        severity.alias("severity"),
        (column if column is not None else F.lit(None).cast("string")).alias("column"),
        F.lit(kind).alias("kind"),
        observed.cast("double").alias("observed"),
        baseline.cast("double").alias("baseline"),
        message.alias("message"),
    )
    return F.when(severity.isNotNull(), entry)


def _percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def drift(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Drift findings of every snapshot that has a predecessor.

    ``tables`` has ``source_key, profiled_at, row_count``; ``columns`` has ``source_key, profiled_at, column,
    null_rate, distinct_count, mean, stddev``.
    """
    linked = with_previous(tables.select(*KEY, "row_count"), ["source_key"], "profiled_at", ["profiled_at", "row_count"])
    linked = linked.filter(F.col("prev_profiled_at").isNotNull())
    per_column = _paired_columns(linked, columns)
    frames = [
        linked.select(*KEY, _row_count_finding().alias("f")),
        per_column.select(*KEY, F.explode(F.array_compact(F.array(*_column_findings()))).alias("f")),
    ]
    found = reduce(DataFrame.unionByName, frames).filter(F.col("f").isNotNull())
    return found.select(*KEY, *(F.col(f"f.{name}").alias(name) for name in FINDING))


def _row_count_finding() -> Column:
    now, before = F.col("row_count"), F.col("prev_row_count")
    change = F.when(before != 0, (now - before) / before)
    severity = F.when(F.abs(change) >= ROWS_HIGH, "high").when(F.abs(change) >= ROWS_MEDIUM, "medium")
    text = F.format_string("Rows went from %d to %d (%s).", before, now, F.format_string("%+.0f%%", change * 100))
    return _finding("row_count", severity, now, before, text)


def _paired_columns(linked: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns of a snapshot beside those of its predecessor; either side may be missing.

    Each column snapshot plays two parts, the current one for its own check and the earlier one for the next, so one
    join and one aggregation pair them all.
    """

    def part(own_at: str, name: str):
        return F.struct(F.col(own_at).alias("own_at"), F.col("profiled_at").alias("check_at"), F.lit(name).alias("part"))

    parts = linked.select("source_key", F.inline(F.array(part("profiled_at", "now"), part("prev_profiled_at", "before"))))
    stats = F.struct("null_rate", "distinct_count", "mean", "stddev").alias("s")
    known = columns.select("source_key", F.col("profiled_at").alias("own_at"), "column", stats)
    sides = (F.max(F.when(F.col("part") == name, F.col("s"))).alias(name) for name in ("now", "before"))
    return (
        known.join(parts, ["source_key", "own_at"])
        .groupBy("source_key", F.col("check_at").alias("profiled_at"), "column")
        .agg(*sides)
    )


def _column_findings() -> list[Column]:
    now, before, name = F.col("now"), F.col("before"), F.col("column")
    both = now.isNotNull() & before.isNotNull()
    nothing = F.lit(None)

    vanished = _finding(
        "column_vanished", F.when(now.isNull(), "medium"), nothing, nothing, F.lit("The column is no longer in the source."), name
    )
    appeared = _finding(
        "column_appeared", F.when(before.isNull(), "low"), nothing, nothing, F.lit("The column is new in the source."), name
    )

    nulls, nulls_before = F.coalesce(now["null_rate"], F.lit(0.0)), F.coalesce(before["null_rate"], F.lit(0.0))
    rise = nulls - nulls_before
    risen = (rise >= NULLS_MEDIUM) & (nulls > NULLS_FACTOR * F.greatest(nulls_before, F.lit(NULLS_FLOOR)))
    null_rate = _finding(
        "null_rate",
        F.when(both & (rise >= NULLS_HIGH), "high").when(both & risen, "medium"),
        nulls,
        nulls_before,
        F.format_string("NULLs rose from %s to %s of rows.", _percent(nulls_before), _percent(nulls)),
        name,
    )

    distinct, distinct_before = now["distinct_count"], before["distinct_count"]
    dropped = (distinct_before > 0) & (distinct < distinct_before * DISTINCT_DROP)
    distinct_count = _finding(
        "distinct_count",
        F.when(both & dropped, "medium"),
        distinct,
        distinct_before,
        F.format_string("Distinct values fell from %d to %d.", distinct_before, distinct),
        name,
    )

    mean, mean_before, spread = now["mean"], before["mean"], before["stddev"]
    shifted = (spread != 0) & (F.abs(mean - mean_before) > MEAN_STDDEVS * spread)
    mean_shift = _finding(
        "mean",
        F.when(both & shifted, "medium"),
        mean,
        mean_before,
        F.format_string("The mean moved from %.4f to %.4f, over three standard deviations.", mean_before, mean),
        name,
    )
    return [vanished, appeared, null_rate, distinct_count, mean_shift]


def report_order() -> list[Column]:
    """Severity first; within it, content findings, row count, vanished, appeared, then changes column by column."""

    def listed(ranks: dict[str, int], default: int) -> Column:
        return F.coalesce(*(F.when(F.col("kind") == kind, rank) for kind, rank in ranks.items()), F.lit(default))

    is_content = F.col("seq").isNotNull()
    return [
        severity_rank(F.col("severity")),
        F.when(is_content, -1).otherwise(listed(_GROUPS, 3)),
        F.coalesce(F.col("seq"), F.lit(0)),
        F.col("column").asc_nulls_first(),
        listed(_PER_COLUMN, 0),
    ]


def report(content_findings: DataFrame, drift_findings: DataFrame | None) -> DataFrame:
    """The findings of one check in reading order. Without a predecessor only content findings remain."""
    content = content_findings.select(*FINDING, F.col("seq"))
    if drift_findings is None:
        return content.orderBy("seq").drop("seq")
    found = content.unionByName(drift_findings.select(*FINDING, F.lit(None).cast("int").alias("seq")))
    return found.orderBy(*report_order()).drop("seq")


def check_history(tables: DataFrame, drift_findings: DataFrame) -> DataFrame:
    """Per snapshot: rows, all findings, high-severity findings and privacy flags."""
    drifted = drift_findings.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("__drift"), F.count_if(F.col("severity") == "high").alias("__high")
    )

    def own(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) if name in tables.columns else F.lit(0)

    return tables.join(drifted, list(KEY), "left").select(
        *KEY,
        "row_count",
        (own("finding_count") + F.coalesce("__drift", F.lit(0))).cast("long").alias("finding_count"),
        (own("high_finding_count") + F.coalesce("__high", F.lit(0))).cast("long").alias("high_severity_count"),
        own("privacy_count").cast("long").alias("privacy_count"),
    )
