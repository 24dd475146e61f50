"""Checks made while data is written: the tasks that write the rows also count for the rules."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation, Row, functions as F, types as T

from plumbline.plans.runner import (
    EVIDENCE_LIMIT, FOLDED_RULES, PARTS, BatchResult, PlannedRule, Planner, _execute, _parts, _result,
)
from plumbline.spec import ROW_RULES, Connection, Rule, RuleType

OBSERVED = ROW_RULES | {RuleType.ROW_COUNT, RuleType.DATA_FRESHNESS}
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def write_checked(
    df: DataFrame,
    path: str,
    rules: Sequence[Rule],
    connections: Mapping[int, Connection],
    *,
    partition_by: Sequence[str] = (),
    executed_by: str = "user",
    as_of: datetime | None = None,
    schedule_id: int | None = None,
    evidence_limit: int | None = EVIDENCE_LIMIT,
) -> BatchResult:
    """Write ``df`` as Parquet in place of what ``path`` holds, and run the rules on it; the result is that of ``run_rules``.

    Row rules, row counts and freshness are observed by the writing tasks and cost no scan. No shuffle follows the counting,
    so a task that is repeated after an executor is lost is counted once. Key rules, reference checks and custom SQL need rows
    together; they, and evidence, read what was written. Rules that cannot be planned end in ``error`` and do not stop the
    write; should counting fail while writing, the rows are written without it and every rule reads them.
    """
    spark, started = df.sparkSession, datetime.now(timezone.utc)
    as_of = as_of or started
    observed = [p for p in _planned(Planner(spark, connections, as_of, df), rules) if p.error is None and p.rule.rule_type in OBSERVED]
    clock = time.perf_counter()
    try:
        counts = _write(df, path, partition_by, observed)
    except Exception:
        if not observed:
            raise
        observed, counts = [], _write(df, path, partition_by, [])
    spent = round((time.perf_counter() - clock) * 1000)

    written = spark.read.schema(df.schema).parquet(path)
    planned = _planned(Planner(spark, connections, as_of, written), rules)
    known = {p.position for p in observed}
    rest, runtimes, errors = _execute(spark, _parts([p for p in planned if p.position not in known]))
    runtimes |= dict.fromkeys(known, spent)
    return _result(spark, planned, counts + rest, runtimes, errors, started, executed_by, schedule_id, evidence_limit)


def _planned(planner: Planner, rules: Sequence[Rule]) -> list[PlannedRule]:
    return [planner.plan(rule, i) for i, rule in enumerate(rules)]


def _write(df: DataFrame, path: str, partition_by: Sequence[str], observed: Sequence[PlannedRule]) -> list[Row]:
    """Write the rows; one row of counts for each rule, from one pass however many there are."""
    groups = [observed[start : start + FOLDED_RULES] for start in range(0, len(observed), FOLDED_RULES)]
    seen = [Observation() for _ in groups]
    for observation, group in zip(seen, groups, strict=True):
        df = df.observe(observation, F.count(F.lit(1)).alias("n"), *(c for p in group for c in _measures(p)))
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return [_counts(p, observation.get) for observation, group in zip(seen, groups, strict=True) for p in group]


def _measures(p: PlannedRule) -> list[Column]:
    measures = [p.fold.failed.cast("long").alias(f"f{p.position}")]
    if p.fold.latest is not None:
        # As a number, which means the same in every time zone.
        measures += [F.unix_micros(p.fold.latest).alias(f"l{p.position}"), p.fold.age.alias(f"a{p.position}")]
    return measures


def _counts(p: PlannedRule, found: Mapping[str, object]) -> Row:
    micros = found.get(f"l{p.position}")
    latest = None if micros is None else EPOCH + timedelta(microseconds=micros)
    values = (p.position, found["n"], found[f"f{p.position}"], latest, found.get(f"a{p.position}"))
    return Row(*T.StructType.fromDDL(PARTS).names)(*values)

