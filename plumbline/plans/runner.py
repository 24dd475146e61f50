"""Running rules: a batch is a few independent parts, each yielding one row per rule it counts.

Row rules, row counts and freshness of one source are folded into a single scan. Key rules, reference checks and
custom SQL are parts of their own. ``summarise`` joins all parts into one unevaluated query; ``run_rules`` submits them side
by side and times each. Should a part fail, it alone is run again, in halves, until the rule that cannot be evaluated stands
by itself; only that one ends in ``error``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timezone
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from plumbline.functions.frames import small_frame
from plumbline.functions.scalar import col_of, quoted
from plumbline.operators import sqlrules, volume
from plumbline.operators.keys import DuplicateKeys, KeyedComparison, MissingReferences
from plumbline.operators.predicates import failing_predicate
from plumbline.plans.parallel import MAX_QUERIES
from plumbline.sources import catalog
from plumbline.spec import KEY_RULES, ROW_RULES, Connection, Rule, RuleType, require_valid

EVIDENCE_LIMIT = 500
FOLDED_RULES = 64  # rules per shared scan; Spark stops generating code beyond 100 fields
EVIDENCE_SLICES = 256  # scan tasks are dealt to so many first steps, which hand at most the limit of rows to the last one

PARTS = "position int, checked_count long, failed_count long, latest_value timestamp, freshness_age_days double"
META = (
    "position int, rule_id long, rule_name string, rule_type string, source_label string, "
    "tolerance_rows long, tolerance_percent double, max_age_days int, error string"
)
RUN = (
    "rule_id long, rule_name string, rule_type string, source_label string, status string, executed_by string, "
    "started_at timestamp, finished_at timestamp, runtime_ms long, checked_count long, failed_count long, "
    "fail_threshold_allowed long, latest_value timestamp, freshness_age_days double, max_age_days int, error string, "
    "schedule_id long"
)
EVIDENCE = "execution_datetime timestamp, rule_id long, row_json string"


@dataclass(frozen=True, slots=True)
class Fold:
    """What a rule needs from the shared scan of its source."""

    failed: Column
    latest: Column | None = None
    age: Column | None = None


@dataclass(slots=True)
class PlannedRule:
    rule: Rule
    position: int
    source_key: str | None = None
    source: DataFrame | None = None
    fold: Fold | None = None
    branch: DataFrame | None = None  # own one-row result: checked_count, failed_count
    predicate: Column | None = None
    evidence: Callable[[int], DataFrame] | None = None  # failing rows, at least n of them where there are so many
    failing: Callable[[], DataFrame] | None = None  # all failing rows
    error: str | None = None


@dataclass(slots=True)
class BatchResult:
    """``runs`` has one row per rule in input order; ``evidence`` at most 500 failing rows per rule, unevaluated."""

    runs: DataFrame
    evidence: DataFrame
    statuses: list[str] = field(default_factory=list)


def tolerance(config: Mapping[str, object]) -> tuple[int, float]:
    """Allowed failing rows and percent; unusable settings count as 0."""

    def number(key: str, kind: type) -> float:
        try:
            return max(kind(0), kind(config.get(key) or 0))
        except (TypeError, ValueError):
            return kind(0)

    return int(number("fail_threshold_count", int)), float(number("fail_threshold_percent", float))


class Planner:
    """Plans rules against connections. Each source is opened once however many rules use it."""

    def __init__(
        self,
        spark: SparkSession,
        connections: Mapping[int, Connection],
        as_of: datetime | None = None,
        source: DataFrame | None = None,
    ) -> None:
        self.spark = spark
        self.source = source  # given outright, for example a micro-batch, it replaces every rule's own source
        self.connections = connections
        self.as_of = as_of or datetime.now(timezone.utc)
        self._frames: dict[str, DataFrame] = {}

    def frame(self, rule: Rule, side: str = "source") -> tuple[str, DataFrame]:
        if side == "source" and self.source is not None:
            return "given", self.source
        key = json.dumps(catalog.source_of(rule.config, side), sort_keys=True, default=str)
        if key not in self._frames:
            self._frames[key] = catalog.load(self.spark, rule.config, self.connections, side)
        return key, self._frames[key]

    def tables(self, connection: Connection, mentioned_in: str) -> dict[str, DataFrame]:
        return catalog.connection_tables(self.spark, connection, mentioned_in)

    def plan(self, rule: Rule, position: int = 0) -> PlannedRule:
        """Plan one rule. Problems with its settings, source or columns are kept on the plan, not raised."""
        planned = PlannedRule(rule, position)
        try:
            self._fill(planned)
        except Exception as error:
            return PlannedRule(rule, position, error=_message(error))
        return planned

    def _fill(self, p: PlannedRule) -> None:
        rule, kind = p.rule, p.rule.rule_type
        config = require_valid(kind, rule.config)
        if kind == RuleType.CUSTOM_SQL_CONNECTION:
            self._fill_connection_sql(p, config)
            return
        p.source_key, df = self.frame(rule)
        p.source = df
        if kind in ROW_RULES:
            predicate = failing_predicate(rule, df)
            df.select(predicate)  # analyse now, so that a column or type problem belongs to this rule alone
            p.predicate, p.fold = predicate, Fold(F.count_if(predicate))
            p.failing = lambda: df.filter(predicate)
            p.evidence = lambda n: p.failing()
        elif kind == RuleType.ROW_COUNT:
            failed = volume.row_count_failed(
                int(config.get("min_count", 0)), int(config.get("max_count", volume.DEFAULT_MAX_COUNT))
            )
            p.fold = Fold(failed)
            p.failing = lambda: df.agg(F.count(F.lit(1)).alias("actual_count"), failed.alias("__f")).filter("__f = 1").drop("__f")
            p.evidence = lambda n: p.failing()
        elif kind == RuleType.DATA_FRESHNESS:
            self._fill_freshness(p, df, int(config["max_age_days"]), *col_of(df, config["column"]))
        elif kind in KEY_RULES:
            self._fill_keyed(p, DuplicateKeys(df, list(config["columns"])))
        elif kind == RuleType.REFERENTIAL_INTEGRITY:
            _, target = self.frame(rule, "target")
            native = self._same_database(config)
            self._fill_keyed(p, MissingReferences(df, config["source_key"], target, config["target_key"], native=native))
        elif kind == RuleType.KEYED_COMPARISON:
            target = self._comparison_target(rule)
            self._fill_keyed(p, KeyedComparison(df, config["key_column"], list(config["compare_columns"]), target))
        else:
            build = sqlrules.fail_rows if kind == RuleType.CUSTOM_SQL_FAIL_ROWS else sqlrules.threshold_rows
            rows = build(self.spark, config, df)
            p.fold, p.branch = Fold(F.lit(0).cast("long")), _counted(rows, checked=False)
            p.failing, p.evidence = (lambda: rows), (lambda n: rows)

    def _fill_connection_sql(self, p: PlannedRule, config: Mapping[str, object]) -> None:
        connection = catalog.connection_of(catalog.source_of(config), self.connections)
        if connection.is_files:
            rows = sqlrules.connection_rows(self.spark, config, self.tables(connection, str(config["sql"])))
        elif connection.is_database:
            rows = catalog.read_jdbc(self.spark, connection, sql=str(config["sql"]))
        else:
            rows = sqlrules.connection_rows(self.spark, config, {})
        p.branch = _counted(rows, checked=True)
        p.failing, p.evidence = (lambda: rows), (lambda n: rows)

    def _fill_freshness(self, p: PlannedRule, df: DataFrame, days: int, c: Column, dtype: object) -> None:
        latest = volume.latest_instant(c, dtype)
        age = volume.age_days(latest, self.as_of)
        p.fold = Fold(volume.stale(latest, self.as_of, days), latest, age)
        df.agg(p.fold.failed)
        text = F.when(F.col("latest_value").isNull(), "No readable latest value.").otherwise("The latest value is too old.")
        p.failing = lambda: (
            df.agg(latest.alias("latest_value"), age.alias("freshness_age_days"), p.fold.failed.alias("__f"))
            .filter("__f = 1")
            .select("latest_value", "freshness_age_days", F.lit(days).alias("max_age_days"), text.alias("finding"))
        )
        p.evidence = lambda n: p.failing()

    def _fill_keyed(self, p: PlannedRule, check: DuplicateKeys | MissingReferences | KeyedComparison) -> None:
        p.branch, p.failing, p.evidence = check.counts(), check.failing, check.evidence

    def _same_database(self, config: Mapping[str, object]) -> bool:
        ids = [catalog.source_of(config, side)["connection_id"] for side in ("source", "target")]
        return ids[0] == ids[1] and self.connections[int(ids[0])].is_database

    def _comparison_target(self, rule: Rule) -> DataFrame:
        """A full target source if one is set, else a relation of the source's own connection by name."""
        if rule.config.get("target_connection_id"):
            return self.frame(rule, "target")[1]
        relation = str(rule.config["target_relation"])
        connection = catalog.connection_of(catalog.source_of(rule.config), self.connections)
        if connection.is_database:
            return catalog.read_jdbc(self.spark, connection, table=relation)
        tables = self.tables(connection, relation) if connection.is_files else {}
        return tables[relation] if relation in tables else self.spark.table(relation)


def _counted(rows: DataFrame, *, checked: bool) -> DataFrame:
    n = F.count(F.lit(1))
    return rows.agg((n if checked else F.lit(0).cast("long")).alias("checked_count"), n.alias("failed_count"))


def _message(error: Exception) -> str:
    return str(error).split("\n\nJVM stacktrace", 1)[0]


def _as_parts(df: DataFrame, position: int) -> DataFrame:
    return df.select(
        F.lit(position).alias("position"),
        "checked_count",
        "failed_count",
        F.lit(None).cast("timestamp").alias("latest_value"),
        F.lit(None).cast("double").alias("freshness_age_days"),
    )


def _scan(source: DataFrame, planned: Sequence[PlannedRule]) -> DataFrame:
    """One pass over a source for many rules, then one row per rule."""
    aggregates, rows = [F.count(F.lit(1)).alias("n")], []
    for p in planned:
        i = p.position
        aggregates.append(p.fold.failed.cast("long").alias(f"f{i}"))
        latest, age = F.lit(None).cast("timestamp"), F.lit(None).cast("double")
        if p.fold.latest is not None:
            aggregates += [p.fold.latest.alias(f"l{i}"), p.fold.age.alias(f"a{i}")]
            latest, age = F.col(f"l{i}"), F.col(f"a{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("position"),
                F.col("n").alias("checked_count"),
                F.col(f"f{i}").alias("failed_count"),
                latest.alias("latest_value"),
                age.alias("freshness_age_days"),
            )
        )
    return source.agg(*aggregates).select(F.inline(F.array(*rows)))


@dataclass(frozen=True, slots=True)
class Part:
    """Rules counted by one query; those of a shared scan can be counted in smaller parts as well."""

    rules: tuple[PlannedRule, ...]
    counts: DataFrame

    def halves(self) -> tuple[Part, Part]:
        middle = len(self.rules) // 2
        first, second = self.rules[:middle], self.rules[middle:]
        return Part(first, _scan(first[0].source, first)), Part(second, _scan(second[0].source, second))


def _parts(planned: Sequence[PlannedRule]) -> list[Part]:
    parts: list[Part] = []
    by_source: dict[str, list[PlannedRule]] = {}
    for p in planned:
        if p.error is None and p.fold is not None:
            by_source.setdefault(p.source_key, []).append(p)
        if p.error is None and p.branch is not None:
            parts.append(Part((p,), _as_parts(p.branch, p.position)))
    for group in by_source.values():
        for start in range(0, len(group), FOLDED_RULES):
            rules = tuple(group[start : start + FOLDED_RULES])
            parts.append(Part(rules, _scan(rules[0].source, rules)))
    return parts


def summary_frame(spark: SparkSession, planned: Sequence[PlannedRule], counts: DataFrame | None = None) -> DataFrame:
    """Counts, tolerance and status of planned rules, one row each, unevaluated; ``counts`` are those of parts that have run."""
    if counts is None:
        frames = [part.counts for part in _parts(planned)]
        counts = reduce(DataFrame.unionByName, frames) if frames else small_frame(spark, [], PARTS)
    meta = small_frame(spark, [_meta(p) for p in planned], META)
    totals = counts.groupBy("position").agg(
        F.sum("checked_count").alias("checked_count"),
        F.sum("failed_count").alias("failed_count"),
        F.max("latest_value").alias("latest_value"),
        F.max("freshness_age_days").alias("freshness_age_days"),
    )
    checked, failed = F.coalesce("checked_count", F.lit(0)), F.coalesce("failed_count", F.lit(0))
    share = F.floor(checked * F.col("tolerance_percent") / 100)
    allowed = F.greatest(
        F.col("tolerance_rows"), F.when((F.col("tolerance_percent") > 0) & (checked > 0), share).otherwise(0)
    ).cast("long")
    return (
        meta.join(totals, "position", "left")
        .withColumn("checked_count", checked.cast("long"))
        .withColumn("failed_count", failed.cast("long"))
        .withColumn("__allowed", allowed)
        .withColumn(
            "status",
            F.when(F.col("error").isNotNull(), "error")
            .when(F.col("failed_count") <= F.col("__allowed"), "passed")
            .otherwise("failed"),
        )
        .withColumn("fail_threshold_allowed", F.when((F.col("__allowed") > 0) & F.col("error").isNull(), F.col("__allowed")))
        .drop("__allowed", "tolerance_rows", "tolerance_percent")
    )


def _meta(p: PlannedRule) -> tuple:
    rows, percent = tolerance(p.rule.config)
    days = p.rule.config.get("max_age_days") if p.rule.rule_type == RuleType.DATA_FRESHNESS and not p.error else None
    days = None if days is None else int(days)
    return (p.position, p.rule.id, p.rule.name, p.rule.rule_type.value, p.rule.source_label, rows, percent, days, p.error)


def summarise(
    spark: SparkSession, rules: Sequence[Rule], connections: Mapping[int, Connection], as_of: datetime | None = None
) -> DataFrame:
    """The batch summary as a DataFrame, nothing executed yet."""
    planner = Planner(spark, connections, as_of)
    return summary_frame(spark, [planner.plan(rule, i) for i, rule in enumerate(rules)])


def failing_rows(
    spark: SparkSession, rule: Rule, connections: Mapping[int, Connection], as_of: datetime | None = None
) -> DataFrame:
    """Every failing row of one rule, without a limit."""
    planned = Planner(spark, connections, as_of).plan(rule)
    if planned.error:
        raise ValueError(planned.error)
    return planned.failing()


def run_rules(
    spark: SparkSession,
    rules: Sequence[Rule],
    connections: Mapping[int, Connection],
    *,
    executed_by: str = "user",
    as_of: datetime | None = None,
    schedule_id: int | None = None,
    source: DataFrame | None = None,
    evidence_limit: int | None = EVIDENCE_LIMIT,
) -> BatchResult:
    """Run a batch. A rule's runtime is that of the parts that count it; rules of one shared scan have the scan's.

    ``evidence_limit`` is the number of failing rows kept for each rule, None for all.
    """
    started = datetime.now(timezone.utc)
    planner = Planner(spark, connections, as_of or started, source)
    planned = [planner.plan(rule, i) for i, rule in enumerate(rules)]
    counts, runtimes, errors = _execute(spark, _parts(planned))
    return _result(spark, planned, counts, runtimes, errors, started, executed_by, schedule_id, evidence_limit)


def _result(
    spark: SparkSession, planned: Sequence[PlannedRule], counts: Sequence[Row], runtimes: Mapping[int, int], errors: Mapping[int, str],
    started: datetime, executed_by: str, schedule_id: int | None, evidence_limit: int | None,
) -> BatchResult:
    """Runs and evidence of a batch whose parts have been counted; ``counts`` has a row or more for each rule."""
    planned = [PlannedRule(p.rule, p.position, error=errors[p.position]) if p.position in errors else p for p in planned]
    known = small_frame(
        spark,
        [
            (r.position, r.checked_count, r.failed_count, _utc(r.latest_value), r.freshness_age_days)
            for r in counts
            if r.position not in errors
        ],
        PARTS,
    )
    outcome = {row.position: row.asDict() for row in summary_frame(spark, planned, known).collect()}  # one row per rule
    finished = datetime.now(timezone.utc)
    rows = []
    for p in planned:
        r, millis = outcome[p.position], runtimes.get(p.position, 0)
        rows.append(
            (p.rule.id, p.rule.name, r["rule_type"], r["source_label"], r["status"], executed_by, started, finished, millis,
             r["checked_count"], r["failed_count"], r["fail_threshold_allowed"], _utc(r["latest_value"]),
             r["freshness_age_days"], r["max_age_days"], r["error"], schedule_id)
        )
    failed = {p.position: outcome[p.position]["failed_count"] for p in planned}
    evidence = evidence_frame(spark, planned, failed, started, evidence_limit)
    return BatchResult(small_frame(spark, rows, RUN), evidence, [row[4] for row in rows])


def _utc(value: datetime | None) -> datetime | None:
    return None if value is None else value.astimezone(timezone.utc)


def _run_part(part: Part) -> tuple[list[Row], dict[int, int], dict[int, str]]:
    """Rows, milliseconds and errors of a part, by position. A part that fails is run again in halves."""
    clock = time.perf_counter()
    try:
        rows = part.counts.collect()  # one row per rule
    except Exception as error:
        if len(part.rules) == 1:
            spent = round((time.perf_counter() - clock) * 1000)
            return [], {part.rules[0].position: spent}, {part.rules[0].position: _message(error)}
        first, second = (_run_part(half) for half in part.halves())
        return first[0] + second[0], first[1] | second[1], first[2] | second[2]
    spent = round((time.perf_counter() - clock) * 1000)
    return rows, {p.position: spent for p in part.rules}, {}


def _execute(spark: SparkSession, parts: Sequence[Part]) -> tuple[list[Row], dict[int, int], dict[int, str]]:
    """All parts side by side: their rows, milliseconds of each rule and the errors of those that cannot be evaluated."""
    rows: list[Row] = []
    runtimes: dict[int, int] = {}
    errors: dict[int, str] = {}
    if not parts:
        return rows, runtimes, errors
    with ThreadPoolExecutor(min(MAX_QUERIES, len(parts))) as pool:
        for found, spent, wrong in pool.map(inheritable_thread_target(spark)(_run_part), parts):
            rows += found
            errors |= wrong
            for position, millis in spent.items():
                runtimes[position] = runtimes.get(position, 0) + millis
    return rows, runtimes, errors


def evidence_frame(
    spark: SparkSession,
    planned: Sequence[PlannedRule],
    failed: Mapping[int, int],
    executed_at: datetime,
    limit: int | None = EVIDENCE_LIMIT,
) -> DataFrame:
    """The first ``limit`` failing rows of each rule in the order of their JSON text; all of them for None.

    Rules that failed nowhere need no scan. Row rules of one source share a scan.
    """
    frames: list[DataFrame] = []
    shared: dict[str, list[PlannedRule]] = {}
    for p in planned:
        if p.error or not failed.get(p.position):
            continue
        if p.predicate is not None:
            shared.setdefault(p.source_key, []).append(p)
        else:
            rows = p.failing() if limit is None else p.evidence(limit)
            frames.append(rows.select(F.lit(p.rule.id).cast("long").alias("rule_id"), _json(rows).alias("row_json")))
    frames += [_shared_evidence(group) for group in shared.values()]
    if not frames:
        return small_frame(spark, [], EVIDENCE)
    kept = frames if limit is None else [_first_rows(frame, limit) for frame in frames]
    return reduce(DataFrame.unionByName, kept).select(
        F.lit(executed_at).cast("timestamp").alias("execution_datetime"), "rule_id", "row_json"
    )


def _first_rows(evidence: DataFrame, limit: int) -> DataFrame:
    """The first rows of each rule, in two steps: of every slice of the tasks, then of the slices.

    A task is of one slice and hands over at most ``limit`` rows of a rule, and so does a slice. How tasks are dealt to slices
    does not change the result.
    """
    sliced = evidence.withColumn("__slice", F.spark_partition_id() % EVIDENCE_SLICES)
    for keys in (("rule_id", "__slice"), ("rule_id",)):
        first = Window.partitionBy(*keys).orderBy("row_json")
        sliced = sliced.withColumn("__n", F.row_number().over(first)).filter(F.col("__n") <= limit).drop("__n")
    return sliced.drop("__slice")


def _shared_evidence(group: Sequence[PlannedRule]) -> DataFrame:
    source = group[0].source
    violations = violated_rules([(p.rule.id, p.predicate) for p in group])
    return (
        source.select(violations.alias("__rules"), F.struct(*(F.col(quoted(n)) for n in source.columns)).alias("__row"))
        .filter(F.size("__rules") > 0)
        .select(F.explode("__rules").alias("rule_id"), F.to_json("__row", {"ignoreNullFields": "false"}).alias("row_json"))
    )


def violated_rules(checks: Sequence[tuple[int, Column]]) -> Column:
    """The ids of the rules a row violates, as an array."""
    return F.array_compact(F.array(*(F.when(p, F.lit(rule_id).cast("long")) for rule_id, p in checks)))


def scorecard(source: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Failing rows of a source with the ids of all row rules each one violates, in one pass."""
    checks = [(rule.id, failing_predicate(rule, source)) for rule in rules]
    return source.withColumn("violated_rules", violated_rules(checks)).filter(F.size("violated_rules") > 0)


def _json(rows: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(quoted(name)) for name in rows.columns)), {"ignoreNullFields": "false"})
