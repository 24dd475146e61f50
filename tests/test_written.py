"""Rules while writing: the same results as rules on what was written, without a scan of their own."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.plans import written
from plumbline.plans.runner import run_rules
from plumbline.plans.written import write_checked
from plumbline.spec import Rule, RuleType

AS_OF = datetime(2026, 3, 1, tzinfo=timezone.utc)
SHOWN = ["rule_id", "status", "checked_count", "failed_count", "fail_threshold_allowed", "latest_value", "freshness_age_days", "error"]
ROW_RULES = [
    Rule(1, "range", RuleType.VALUE_RANGE, {"column": "v", "min": 0, "max": 80, "fail_threshold_percent": 30}),
    Rule(2, "set", RuleType.NOT_NULL, {"column": "gap"}),
    Rule(3, "rows", RuleType.ROW_COUNT, {"min_count": 500}),
    Rule(4, "fresh", RuleType.DATA_FRESHNESS, {"column": "t", "max_age_days": 9}),
    Rule(5, "gone", RuleType.NOT_NULL, {"column": "gone"}),
]
OTHERS = [
    Rule(6, "key", RuleType.UNIQUE, {"columns": ["k"]}),
    Rule(7, "sql", RuleType.CUSTOM_SQL_FAIL_ROWS, {"sql": "SELECT * FROM dataset_view WHERE v > 97"}),
]


@pytest.fixture
def rows(spark):
    day = F.timestamp_add("DAY", (F.col("id") % 50).cast("int"), F.lit(datetime(2026, 1, 1, tzinfo=timezone.utc)))
    gap = F.when(F.col("id") % 4 > 0, F.col("id"))
    return spark.range(100).select(F.col("id").alias("v"), gap.alias("gap"), (F.col("id") % 90).alias("k"), day.alias("t"))


def shown(result):
    return [tuple(r) for r in result.runs.select(SHOWN).orderBy("rule_id").collect()]


def test_results_are_those_of_run_rules(spark, rows, tmp_path):
    result = write_checked(rows, str(tmp_path / "out"), ROW_RULES + OTHERS, {}, as_of=AS_OF)
    back = spark.read.parquet(str(tmp_path / "out"))
    plain = run_rules(spark, ROW_RULES + OTHERS, {}, as_of=AS_OF, source=back)
    assert back.count() == 100 and shown(result) == shown(plain)
    assert result.statuses == ["passed", "failed", "failed", "failed", "error", "failed", "failed"]
    both = [{(r.rule_id, r.row_json) for r in found.evidence.collect()} for found in (result, plain)]
    assert both[0] == both[1] and len(both[0]) > 50


def test_row_rules_cost_no_query(spark, rows, tmp_path, monkeypatch):
    seen = []
    execute = written._execute
    monkeypatch.setattr(written, "_execute", lambda spark, parts: seen.extend(parts) or execute(spark, parts))
    many = [Rule(i, f"r{i}", RuleType.VALUE_RANGE, {"column": "v", "min": 0, "max": i}) for i in range(100)]
    result = write_checked(rows, str(tmp_path / "out"), many, {}, as_of=AS_OF)
    assert seen == []
    assert [r.failed_count for r in result.runs.orderBy("rule_id").collect()] == [99 - i for i in range(100)]


def test_the_source_is_computed_once(spark, rows, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    write_checked(rows.mapInPandas(noted, rows.schema), str(tmp_path / "out"), ROW_RULES + OTHERS, {}, as_of=AS_OF)
    assert read.value == 100


def test_no_rows_no_rules_and_rewriting(spark, rows, tmp_path):
    path = str(tmp_path / "out")
    write_checked(rows, path, [], {}, as_of=AS_OF)
    assert spark.read.parquet(path).count() == 100
    result = write_checked(rows.filter("v < 0"), path, ROW_RULES, {}, as_of=AS_OF)
    assert [(r.status, r.checked_count) for r in result.runs.orderBy("rule_id").collect()] == [
        ("passed", 0), ("passed", 0), ("failed", 0), ("failed", 0), ("error", 0)]
    assert spark.read.parquet(path).count() == 0


def test_partitions_of_the_written_table(spark, rows, tmp_path):
    parted = rows.withColumn("half", F.col("v") % 2)
    result = write_checked(parted, str(tmp_path / "out"), ROW_RULES + OTHERS, {}, partition_by=["half"], as_of=AS_OF)
    assert sorted(p.name for p in (tmp_path / "out").glob("half=*")) == ["half=0", "half=1"]
    assert result.statuses == ["passed", "failed", "failed", "failed", "error", "failed", "failed"]


def test_data_that_cannot_be_written_raises(spark, tmp_path):
    broken = spark.range(3).select(F.raise_error(F.lit("broken")).cast("long").alias("v"))
    with pytest.raises(Exception, match="broken"):
        write_checked(broken, str(tmp_path / "out"), ROW_RULES[:1], {}, as_of=AS_OF)
