"""Run history: trends, hotspots and schedule figures from the table of rule runs.

Everything is one aggregation with map-side partial results; "latest per rule" is an aggregate too
(``max_by``), so no rule's history is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# How much each view shows.
TREND_DAYS, OUTCOME_DAYS = 30, 14
OVERVIEW_RUNS, TOP_RULES, SCHEDULE_EXECUTIONS = 100, 8, 50
UNKNOWN_DAY = "Unknown"
STATUS_SEVERITY = {"passed": 0, "failed": 1, "error": 2}

_ISO_START = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?\z"


def _day(runs: DataFrame) -> Column:
    started = F.col("started_at")
    if isinstance(runs.schema["started_at"].dataType, T.StringType):
        day = F.when(started.rlike(_ISO_START), F.substring(started, 1, 10).try_cast("date"))
    else:
        day = started.cast("date")
    return F.coalesce(day.cast("string"), F.lit(UNKNOWN_DAY))


def _share(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.bround(part / whole * 100, digits))


def _is(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def daily(runs: DataFrame, days: int = TREND_DAYS) -> DataFrame:
    """Pass rate, volume, failed rows and mean runtime per day; errors count as volume only. Latest days, oldest first."""
    completed = F.col("passed") + F.col("failed")
    latest = (
        runs.groupBy(_day(runs).alias("day"))
        .agg(
            _is("passed").alias("passed"),
            _is("failed").alias("failed"),
            F.count(F.lit(1)).alias("volume"),
            F.coalesce(F.sum("failed_count"), F.lit(0)).alias("failed_rows"),
            F.bround(F.avg("runtime_ms")).cast("long").alias("mean_runtime_ms"),
        )
        .orderBy(F.desc("day"))
        .limit(days)
    )
    return latest.select(
        "day", _share(F.col("passed"), completed).alias("pass_rate"), "volume", "failed_rows", "mean_runtime_ms"
    ).orderBy("day")


def overview(runs: DataFrame, latest: int = OVERVIEW_RUNS) -> DataFrame:
    """Failures (failed and error) and whole-percent pass rate of completed runs, over the newest runs."""
    newest = runs.orderBy(F.desc("id")).limit(latest)
    counted = newest.agg(F.count(F.lit(1)).alias("runs"), _is("passed").alias("passed"), _is("failed").alias("failed"))
    return counted.select(
        "runs",
        (F.col("runs") - F.col("passed")).alias("failures"),
        _share(F.col("passed"), F.col("passed") + F.col("failed"), 0).alias("pass_rate"),
    )


def outcomes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("runs"))


def top_failing(runs: DataFrame, top: int = TOP_RULES) -> DataFrame:
    """Rules by the failed rows of their latest run, only those that had any."""
    latest = runs.groupBy("rule_id").agg(F.max_by("failed_count", "id").alias("failed_count"), F.max("id").alias("run_id"))
    return latest.filter(F.col("failed_count") > 0).orderBy(F.desc("failed_count"), "run_id").limit(top).drop("run_id")


def slowest(runs: DataFrame, top: int = TOP_RULES) -> DataFrame:
    """Rules by mean runtime of the runs that recorded one."""
    timed = runs.filter(F.col("runtime_ms").isNotNull())
    mean = F.bround(F.avg("runtime_ms")).cast("long")
    per_rule = timed.groupBy("rule_id").agg(mean.alias("mean_runtime_ms"), F.max("id").alias("run_id"))
    return per_rule.orderBy(F.desc("mean_runtime_ms"), "run_id").limit(top).drop("run_id")


def rule_outcomes(runs: DataFrame, rule_id: int, days: int = OUTCOME_DAYS) -> DataFrame:
    """Runs of one rule per day and status, latest days, oldest first."""
    mine = runs.filter(F.col("rule_id") == rule_id)
    per_day = mine.groupBy(_day(runs).alias("day")).agg(*(_is(s).alias(s) for s in STATUS_SEVERITY))
    return per_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def failed_row_series(runs: DataFrame, rule_id: int) -> DataFrame:
    """Failed rows of one rule over time, errors left out."""
    mine = runs.filter((F.col("rule_id") == rule_id) & (F.col("status") != "error"))
    return mine.select("started_at", "failed_count").orderBy("started_at")


def schedule_statistics(runs: DataFrame) -> DataFrame:
    """Automatic runs per schedule. The pass rate here is over all runs, errors included."""
    automatic = runs.filter((F.col("executed_by") == "scheduler") & F.col("schedule_id").isNotNull())
    counted = automatic.groupBy("schedule_id").agg(
        F.count(F.lit(1)).alias("runs"),
        _is("passed").alias("passed"),
        _is("failed").alias("failed"),
        _is("error").alias("errored"),
        F.max("started_at").alias("last_run"),
    )
    return counted.withColumn("pass_rate", _share(F.col("passed"), F.col("runs")))


def schedule_executions(runs: DataFrame, schedule_id: int, latest: int = SCHEDULE_EXECUTIONS) -> DataFrame:
    mine = runs.filter((F.col("executed_by") == "scheduler") & (F.col("schedule_id") == schedule_id))
    return mine.orderBy(F.desc("started_at"), F.desc("id")).limit(latest)


def severity(status: Column) -> Column:
    return F.coalesce(*(F.when(status == s, rank) for s, rank in STATUS_SEVERITY.items()), F.lit(0))


def worst_status(status: Column) -> Column:
    """Aggregate: error before failed before passed."""
    return F.max_by(status, severity(status))


def batch_status(runs: DataFrame, keys: list[str], expected: DataFrame | None = None) -> DataFrame:
    """The status of each batch of runs; an expected batch without any run is an error."""
    found = runs.groupBy(*keys).agg(worst_status(F.col("status")).alias("status"))
    if expected is None:
        return found
    return expected.select(*keys).distinct().join(found, keys, "left").withColumn("status", F.coalesce("status", F.lit("error")))


def latest_per_rule(runs: DataFrame) -> DataFrame:
    """Per rule: latest status, start and failed rows, and the number of runs."""
    last = F.max_by(F.struct("status", "started_at", "failed_count"), "id").alias("last")
    return runs.groupBy("rule_id").agg(last, F.count(F.lit(1)).alias("runs")).select("rule_id", "last.*", "runs")
