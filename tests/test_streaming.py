from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.sources import stores
from plumbline.spec import Rule, RuleType
from plumbline.streaming.checks import start_checks
from plumbline.streaming.volume import windowed_trend

RULES = [
    Rule(1, "range", RuleType.VALUE_RANGE, {"column": "v", "min": 0, "max": 8}),
    Rule(2, "key", RuleType.UNIQUE, {"columns": ["k"]}),
    Rule(3, "gone", RuleType.NOT_NULL, {"column": "gone"}),
]


def feed(spark, tmp_path, n):
    (spark.range(10).select(F.col("id").alias("v"), (F.col("id") % 9).alias("k"), F.lit(n).alias("n"))
     .coalesce(1).write.mode("append").parquet(str(tmp_path / "in")))


def start(spark, tmp_path):
    stream = spark.readStream.schema("v long, k long, n int").parquet(str(tmp_path / "in"))
    paths = {"runs_path": str(tmp_path / "runs"), "evidence_path": str(tmp_path / "evidence"), "checkpoint": str(tmp_path / "state")}
    start_checks(stream, RULES, {}, name="checks", available_now=True, **paths).awaitTermination()


def test_each_batch_is_recorded_once(spark, tmp_path):
    feed(spark, tmp_path, 1)
    start(spark, tmp_path)
    feed(spark, tmp_path, 2)
    start(spark, tmp_path)
    start(spark, tmp_path)  # nothing new
    runs = stores.read(spark, str(tmp_path / "runs"))
    found = {(r.batch, r.rule_id): (r.status, r.checked_count, r.failed_count) for r in runs.collect()}
    expected = {1: ("failed", 10, 1), 2: ("failed", 10, 2), 3: ("error", 0, 0)}
    assert found == {(f"checks-{b:012d}", i): e for b in (0, 1) for i, e in expected.items()}
    evidence = stores.read(spark, str(tmp_path / "evidence")).groupBy("rule_id").count()
    assert {r.rule_id: r["count"] for r in evidence.collect()} == {1: 2, 2: 4}


def test_windows_count_rows_and_violations(spark):
    df = spark.createDataFrame([("2026-01-01 00:10:00", 1), ("2026-01-01 00:50:00", 9), ("2026-01-01 01:00:00", 9)], "t string, v int")
    trend = windowed_trend(df.withColumn("t", F.to_timestamp_ntz("t")), "t", "1 hour", RULES[:1], min_count=2)
    assert [(r.row_count, r.failed_1, r.status) for r in trend.orderBy("window_start").collect()] == [(2, 1, "passed"), (1, 1, "failed")]
