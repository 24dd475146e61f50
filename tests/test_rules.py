"""Rule results on small CSV files, row by row where it matters."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from plumbline.operators import hierarchy
from plumbline.operators.keys import DuplicateKeys, KeyedComparison, MissingReferences
from plumbline.plans import runner
from plumbline.sources import stores
from plumbline.spec import Connection, Rule, RuleType

FILES = {
    "customers.csv": "id,name\n1,Alice\n2,Bob\n2,Charlie\n",
    "orders.csv": "order_id,customer_id\n10,1\n11,3\n12,\n",
    "blank_values.csv": 'code\n"   "\nACTIVE\n',
    "dates.csv": "id,loaded_at\n1,2020-01-01\n",
    "nested/2024 sales-data.csv": "id,amount\n1,5\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("csv")
    for name, text in FILES.items():
        (base / name).parent.mkdir(exist_ok=True)
        (base / name).write_text(text, encoding="utf-8")
    (base / "latin.csv").write_bytes("id;name\n1;Ren\xe9\n2;Zo\xe9\n".encode("latin-1"))
    return str(base)


def rule(id, kind, name, **config):
    source = {"source_connection_id": 1, "source_kind": "csv_file", "source_name": name}
    return Rule(id, f"rule {id}", RuleType(kind), {**source, **config})


def run(spark, folder, *rules, **options):
    result = runner.run_rules(spark, rules, {1: Connection(1, "files", "csv", {"base_path": folder})}, **options)
    return result, [row.asDict() for row in result.runs.collect()]


def test_unique_fails_every_row_of_a_repeated_key(spark, folder):
    result, (row,) = run(spark, folder, rule(1, "unique", "customers.csv", columns=["id"]))
    assert (row["checked_count"], row["failed_count"], row["status"]) == (3, 2, "failed")
    assert sorted(r.row_json for r in result.evidence.collect()) == ['{"id":2,"name":"Bob"}', '{"id":2,"name":"Charlie"}']


@pytest.mark.parametrize(
    "tolerances, status, allowed",
    [
        ({"fail_threshold_count": 2}, "passed", 2),
        ({"fail_threshold_count": 1}, "failed", 1),
        ({"fail_threshold_percent": 70}, "passed", 2),
        ({"fail_threshold_percent": 50}, "failed", 1),
        ({"fail_threshold_count": 0, "fail_threshold_percent": 0}, "failed", None),
    ],
)
def test_tolerance(spark, folder, tolerances, status, allowed):
    _, (row,) = run(spark, folder, rule(1, "unique", "customers.csv", column="id", **tolerances))
    assert (row["status"], row["fail_threshold_allowed"]) == (status, allowed)


def test_reference_check_ignores_missing_keys(spark, folder):
    target = {"target_connection_id": 1, "target_kind": "csv_file", "target_name": "customers.csv", "target_key": "ID"}
    result, (row,) = run(spark, folder, rule(1, "referential_integrity", "orders.csv", source_key="customer_id", **target))
    assert (row["checked_count"], row["failed_count"]) == (3, 1)
    assert [r.row_json for r in result.evidence.collect()] == ['{"order_id":11,"customer_id":3}']


def test_latin_semicolon_file(spark, folder):
    _, (row,) = run(spark, folder, rule(1, "not_null", "latin.csv", column="name"))
    assert (row["checked_count"], row["status"]) == (2, "passed")


def test_freshness_and_date_bounds(spark, folder):
    _, rows = run(
        spark,
        folder,
        rule(1, "data_freshness", "dates.csv", column="loaded_at", max_age_days=1),
        rule(2, "date_validity", "dates.csv", column="loaded_at", min_date="2022-01-01"),
        rule(3, "data_freshness", "dates.csv", column="loaded_at", max_age_days=1, fail_threshold_count=1),
        as_of=datetime(2020, 1, 3, tzinfo=timezone.utc),
    )
    assert [r["failed_count"] for r in rows] == [1, 1, 1]
    assert rows[0]["latest_value"].replace(tzinfo=None) == datetime(2020, 1, 1)
    assert (rows[0]["freshness_age_days"], rows[0]["max_age_days"]) == (2.0, 1)
    assert [r["status"] for r in rows] == ["failed", "failed", "passed"]


def test_a_broken_rule_does_not_stop_the_others(spark, folder):
    _, rows = run(
        spark,
        folder,
        rule(1, "not_null", "customers.csv", column="name"),
        rule(2, "not_null", "customers.csv", column="missing"),
        rule(3, "value_range", "customers.csv", column="name", min=0, max=1),  # fails while running
        rule(4, "unique", "customers.csv", columns=["id"]),
        rule(5, "not_null", "nowhere.csv", column="id"),
        rule(6, "regex", "customers.csv", column="name"),
        executed_by="tester",
    )
    assert [r["rule_id"] for r in rows] == [1, 2, 3, 4, 5, 6]
    assert [r["status"] for r in rows] == ["passed", "error", "error", "failed", "error", "error"]
    assert [r["checked_count"] for r in rows] == [3, 0, 0, 3, 0, 0]
    assert "missing" in rows[1]["error"] and "Missing required setting: pattern" in rows[5]["error"]
    assert rows[0]["error"] is None and rows[0]["executed_by"] == "tester"


def test_sql_over_the_whole_folder(spark, folder):
    sql = "SELECT o.* FROM orders o LEFT JOIN customers c ON o.customer_id = c.id WHERE c.id IS NULL"
    whole = rule(1, "custom_sql_connection", "", source_kind="connection", sql=sql)
    numbered = rule(2, "custom_sql_connection", "", source_kind="connection", sql="SELECT * FROM t_2024_sales_data;")
    _, rows = run(spark, folder, whole, numbered)
    assert [(r["checked_count"], r["failed_count"]) for r in rows] == [(2, 2), (1, 1)]
    assert not any(t.name == "orders" for t in spark.catalog.listTables())


def test_custom_sql_sees_the_source_and_gives_views_back(spark, folder):
    spark.range(3).createOrReplaceTempView("dataset_view")
    _, rows = run(
        spark,
        folder,
        rule(1, "custom_sql_fail_rows", "customers.csv", sql="SELECT * FROM dataset_view WHERE id = 2"),
        rule(2, "custom_sql_threshold", "customers.csv", sql="SELECT COUNT(*) AS value FROM dataset_view", threshold=2),
        rule(3, "custom_sql_threshold", "customers.csv", sql="SELECT COUNT(*) AS value FROM dataset_view", threshold=3, operator="!="),
        rule(4, "custom_sql_threshold", "customers.csv", sql="SELECT 1 AS value", threshold=3, operator="~"),
    )
    assert [(r["checked_count"], r["failed_count"], r["status"]) for r in rows] == [
        (3, 2, "failed"), (3, 1, "failed"), (3, 0, "passed"), (0, 0, "error"),
    ]
    assert spark.table("dataset_view").count() == 3
    spark.catalog.dropTempView("dataset_view")


def test_row_count_bounds_are_inclusive(spark, folder):
    _, rows = run(
        spark, folder,
        rule(1, "row_count", "customers.csv", min_count=3, max_count=3),
        rule(2, "row_count", "customers.csv", max_count=2),
        rule(3, "row_count", "customers.csv"),
    )
    assert [r["failed_count"] for r in rows] == [0, 1, 0]


def test_null_handling_of_row_rules(spark):
    df = spark.createDataFrame([(None, None), ("", 5.0), ("abc", float("nan")), ("x\n", -1.0)], "t string, n double")

    def failed(kind, **config):
        return runner._scan(df, [runner.PlannedRule(None, 0, fold=runner.Fold(F.count_if(
            runner.failing_predicate(Rule(1, "r", RuleType(kind), config), df))))]).first().failed_count

    assert failed("not_null", column="t") == 1  # empty text is a value
    assert failed("value_range", column="n", min=0, max=10) == 2  # NaN sorts above every number
    assert failed("length", column="t", min_length=1) == 1
    assert failed("allowed_values", column="t", values=["abc", ""]) == 1
    assert failed("regex", column="t", pattern="^[a-z]*$") == 1  # "x\n" is not at its end after x
    assert failed("date_validity", column="t") == 4


def test_keys_with_a_missing_part_pass(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a"), (2, "a"), (3, "b")], "a int, b string")
    check = DuplicateKeys(df, ["a", "b"])
    assert tuple(check.counts().first()) == (5, 2)
    assert check.failing().count() == 2


@pytest.mark.parametrize("hot_rows", [None, 1, 3, 1000])
def test_slicing_hot_keys_changes_nothing(spark, hot_rows):
    hot = spark.range(4000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.lit("same").alias("v"))
    expected = hot.groupBy("k").count().filter("count > 1").agg(F.sum("count")).first()[0]
    assert DuplicateKeys(hot, ["k"]).failing(hot_rows).count() == expected
    missing = MissingReferences(hot, "k", spark.range(100).filter("id <> 7"), "id")
    keys = [7 if i % 3 == 0 else i for i in range(4000)]
    brute = sum(1 for k in keys if k == 7 or k >= 100)
    assert missing.failing(hot_rows).count() == tuple(missing.counts().first())[1] == brute


def test_long_text_keys_compare_whole(spark):
    base = "x" * 5000
    df = spark.createDataFrame([(base + "1",), (base + "2",), (base + "2",), (base,)], "t string")
    assert tuple(DuplicateKeys(df, ["t"]).counts().first()) == (4, 2)


def test_text_keys_are_stripped_and_not_numeric(spark):
    source = spark.createDataFrame([(" 1\t",), ("1.0",), ("",), (None,), (" 2",)], "k string")
    target = spark.createDataFrame([(1,), (2,)], "id int")
    check = MissingReferences(source, "k", target, "id")
    assert tuple(check.counts().first()) == (5, 2)
    assert sorted(r.k for r in check.failing().collect()) == ["", "1.0"]


def test_keyed_comparison_multiplies_repeated_keys(spark):
    s = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "z"), (None, "q")], "k int, v string")
    t = spark.createDataFrame([(1, "a"), (1, "a"), (1, "c"), (2, ""), (4, "z")], "k int, v string")
    check = KeyedComparison(s, "k", ["v"], t)
    brute = s.alias("s").join(t.alias("t"), "k").filter("coalesce(s.v, '') <> coalesce(t.v, '')").count()
    assert tuple(check.counts().first()) == (5, brute) == (5, 4)
    assert {(r.k, r.v): r.mismatch_count for r in check.failing().collect()} == {(1, "a"): 1, (1, "b"): 3}


def test_evidence_is_bounded_per_rule_and_appends(spark, tmp_path):
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("odd"))
    rules = [
        Rule(1, "a", RuleType.VALUE_RANGE, {"column": "id", "min": 2990, "max": 1e9}),
        Rule(2, "b", RuleType.VALUE_RANGE, {"column": "odd", "min": 1, "max": 1}),
        Rule(3, "c", RuleType.UNIQUE, {"columns": ["odd"]}),
        Rule(4, "d", RuleType.VALUE_RANGE, {"column": "id", "min": 3, "max": 1e9}),
    ]
    result = runner.run_rules(spark, rules, {}, source=df)
    for batch in ("load-1", "load-2", "load-2"):  # writing a batch again replaces it
        stores.append(result.evidence, str(tmp_path / "e"), batch, partition_by=("rule_id",))
    counts = {r.rule_id: r["count"] for r in stores.read(spark, str(tmp_path / "e")).groupBy("rule_id").count().collect()}
    assert counts == {1: 1000, 2: 1000, 3: 1000, 4: 6}


def test_fused_counts_equal_single_runs(spark):
    df = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("t"))
    rules = [Rule(i, "r", RuleType.LENGTH, {"column": "t", "min_length": i, "max_length": 9}) for i in range(1, 6)]
    together = [r.failed_count for r in runner.run_rules(spark, rules, {}, source=df).runs.collect()]
    alone = [runner.run_rules(spark, [r], {}, source=df).runs.first().failed_count for r in rules]
    assert together == alone == [0, 0, 10, 100, 1000]


def test_one_scan_serves_all_row_rules(spark, folder):
    rules = [rule(i, "length", "customers.csv", column="name", min_length=i) for i in range(1, 20)]
    planner = runner.Planner(spark, {1: Connection(1, "files", "csv", {"base_path": folder})})
    plan = runner.summary_frame(spark, [planner.plan(r, i) for i, r in enumerate(rules)])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 1 and "Python" not in plan


def test_scorecard_lists_every_violation(spark):
    df = spark.createDataFrame([(1, "a"), (20, None), (3, None)], "n int, t string")
    rules = [
        Rule(5, "a", RuleType.VALUE_RANGE, {"column": "n", "min": 0, "max": 10}),
        Rule(6, "b", RuleType.NOT_NULL, {"column": "t"}),
    ]
    assert {r.n: r.violated_rules for r in runner.scorecard(df, rules).collect()} == {20: [5, 6], 3: [6]}


def test_column_names_with_dots_and_blanks(spark):
    df = spark.createDataFrame([(1, "a", 2), (1, None, 3)], "`a.b` int, `x y` string, `q``q` int")
    rules = [
        Rule(1, "a", RuleType.UNIQUE, {"columns": ["a.b"]}),
        Rule(2, "b", RuleType.NOT_NULL, {"column": "X Y"}),
        Rule(3, "c", RuleType.VALUE_RANGE, {"column": "q`q", "min": 3, "max": 3}),
    ]
    result = runner.run_rules(spark, rules, {}, source=df)
    assert [r.failed_count for r in result.runs.collect()] == [2, 1, 1]
    assert result.evidence.filter("rule_id = 2").first().row_json == '{"a.b":1,"x y":null,"q`q":3}'
    assert DuplicateKeys(df, ["a.b"]).failing().columns == df.columns


def test_rules_of_a_group_run_together(spark):
    resolved = spark.createDataFrame([(5, 1), (5, 2), (6, 3)], "group_id long, rule_id long")
    rules = [Rule(i, f"r{i}", RuleType.NOT_NULL, {"column": "id"}) for i in (1, 2, 3)]
    chosen = hierarchy.rules_to_run(resolved, 5, rules)
    result = runner.run_rules(spark, chosen, {}, source=spark.range(4))
    assert [(r.rule_id, r.status) for r in result.runs.collect()] == [(1, "passed"), (2, "passed")]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_shuffle_keys_only(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "id % 10 AS k", "repeat('x', 100) AS wide").write.parquet(path)
    df = spark.read.parquet(path)
    check = DuplicateKeys(df, ["k"])
    counts = plan_of(check.counts())
    assert counts.count("Exchange") == 2 and "partial_count" in counts and "ReadSchema: struct<k:bigint>" in counts
    evidence = plan_of(check.evidence(500))  # rows meet at most 500 keys and stay where they are
    rows_side = evidence[evidence.index("LeftSemi") : evidence.index("BroadcastExchange")]
    assert "hashpartitioning" not in rows_side and "wide" in rows_side
    compared = plan_of(KeyedComparison(df, "k", ["id"], df).counts())
    assert "Join" not in compared  # pairs are counted, not built


def test_one_failing_rule_repeats_its_own_scan_only(spark, monkeypatch):
    df = spark.range(100).select("id", F.concat(F.lit("x"), "id").alias("text"))
    rules = [Rule(i, f"r{i}", RuleType.NOT_NULL, {"column": "id"}) for i in range(1, 16)]
    rules += [
        Rule(16, "r16", RuleType.VALUE_RANGE, {"column": "text", "min": 0, "max": 1}),  # fails while running
        Rule(17, "r17", RuleType.UNIQUE, {"columns": ["id"]}),
    ]
    sizes = []
    run_part = runner._run_part
    monkeypatch.setattr(runner, "_run_part", lambda part: sizes.append(len(part.rules)) or run_part(part))
    runs = runner.run_rules(spark, rules, {}, source=df).runs.collect()
    assert [r.status for r in runs] == ["passed"] * 15 + ["error", "passed"]
    assert sorted(sizes) == [1, 1, 1, 2, 2, 4, 4, 8, 8, 16]  # the key rule once, the shared scan in halves down to the bad rule
    assert all(r.runtime_ms > 0 for r in runs)


def test_evidence_is_the_first_rows_at_every_size(spark):
    df = spark.range(0, 4000, 1, 7).select("id", (F.col("id") % 2).alias("odd"))
    checked = Rule(1, "a", RuleType.VALUE_RANGE, {"column": "odd", "min": 1, "max": 1})
    every = sorted(f'{{"id":{i},"odd":0}}' for i in range(0, 4000, 2))
    for limit, wanted in ((10, every[:10]), (500, every[:500]), (None, every)):
        found = runner.run_rules(spark, [checked], {}, source=df, evidence_limit=limit).evidence
        assert sorted(r.row_json for r in found.collect()) == wanted
    empty = runner.run_rules(spark, [checked], {}, source=df.filter("id < 0"))
    assert empty.statuses == ["passed"] and empty.evidence.isEmpty()


def test_evidence_reaches_one_task_only_in_bounded_pieces(spark):
    df = spark.range(0, 4000, 1, 7).select("id", (F.col("id") % 2).alias("odd"))
    checked = Rule(1, "a", RuleType.UNIQUE, {"columns": ["odd"]})
    evidence = runner.run_rules(spark, [checked], {}, source=df).evidence
    plan = evidence._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert evidence.count() == 500
