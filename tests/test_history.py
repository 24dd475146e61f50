from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import functions as F

from plumbline.operators import drift, hierarchy, history
from plumbline.plans.ordered import with_previous

RUN = "id long, rule_id long, status string, started_at string, failed_count long, runtime_ms long"


def test_daily_metrics(spark):
    rows = [
        (1, 1, "passed", "2026-07-20T10:00:00+00:00", 0, 100),
        (2, 1, "failed", "2026-07-20T11:00:00+00:00", 4, 300),
        (3, 1, "error", "2026-07-20T12:00:00+00:00", 0, None),
        (4, 1, "error", "2026-07-21T10:00:00+00:00", 0, None),
        (5, 1, "passed", "whenever", 0, 5),
    ]
    found = [tuple(r) for r in history.daily(spark.createDataFrame(rows, RUN)).collect()]
    assert found == [("2026-07-20", 50.0, 3, 4, 200), ("2026-07-21", None, 1, 0, None), ("Unknown", 100.0, 1, 0, 5)]


def test_daily_keeps_the_latest_thirty_days(spark):
    days = [str(date(2026, 6, 1) + timedelta(days=i)) for i in range(31)]
    runs = spark.createDataFrame([(i, 1, "passed", d, 0, 1) for i, d in enumerate(days)], RUN)
    found = [r.day for r in history.daily(runs).collect()]
    assert (len(found), found[0], found[-1]) == (30, "2026-06-02", "2026-07-01")


def test_batch_status(spark):
    rows = [(1, 1, "passed", "", 0, 0), (2, 1, "error", "", 0, 0), (3, 2, "failed", "", 0, 0), (4, 2, "passed", "", 0, 0), (5, 3, "passed", "", 0, 0)]
    expected = spark.createDataFrame([(1,), (2,), (3,), (4,)], "rule_id long")
    found = history.batch_status(spark.createDataFrame(rows, RUN), ["rule_id"], expected)
    assert {r.rule_id: r.status for r in found.collect()} == {1: "error", 2: "failed", 3: "passed", 4: "error"}


def test_top_lists(spark):
    rows = [(1, 1, "failed", "", 9, 10), (2, 1, "failed", "", 2, 20), (3, 2, "failed", "", 2, 90), (4, 3, "passed", "", 0, None)]
    runs = spark.createDataFrame(rows, RUN)
    assert [tuple(r) for r in history.top_failing(runs).collect()] == [(1, 2), (2, 2)]
    assert [tuple(r) for r in history.slowest(runs).collect()] == [(2, 90), (1, 15)]


GROUPS = "id long"


def resolve(spark, edges, members, groups, rules):
    e = spark.createDataFrame(edges, "parent_id long, child_id long")
    m = spark.createDataFrame(members, "group_id long, rule_id long")
    g, r = (spark.createDataFrame([(i,) for i in ids], GROUPS) for ids in (groups, rules))
    closed = hierarchy.closure(e, g)
    found = {row.group_id: (row.rules, row.missing_rules, row.missing_groups) for row in hierarchy.resolve(closed, e, m, g, r).collect()}
    return found, closed, e, m, r


def test_nested_groups_share_rules(spark):
    found, closed, _, m, r = resolve(spark, [(11, 10)], [(11, 1), (11, 2), (10, 2)], [10, 11], [1, 2])
    assert found == {11: (2, 0, 0), 10: (1, 0, 0)}
    assert sorted(tuple(x) for x in hierarchy.group_rules(closed, m, r).collect()) == [(10, 2), (11, 1), (11, 2)]


def test_missing_rules_and_groups_are_counted(spark):
    found, *_ = resolve(spark, [(11, 404)], [(11, 1), (11, 999)], [11], [1])
    assert found == {11: (1, 1, 1)}


def test_cycles_are_found_and_harmless(spark):
    found, closed, edges, _, _ = resolve(spark, [(1, 2), (2, 3), (3, 1), (3, 4)], [(4, 9)], [1, 2, 3, 4], [9])
    assert {g: n[0] for g, n in found.items()} == {1: 1, 2: 1, 3: 1, 4: 1}
    assert sorted(r.group_id for r in hierarchy.groups_in_cycles(edges).collect()) == [1, 2, 3]
    chain = spark.createDataFrame([(2, 1)], "parent_id long, child_id long")
    assert hierarchy.would_create_cycle(chain, 1, [2]) and not hierarchy.would_create_cycle(chain, 2, [1])
    targets = spark.createDataFrame([(1,)], GROUPS)
    assert [tuple(r) for r in hierarchy.ancestors(chain, targets).collect()] == [(1, 2)]


def test_rollup(spark):
    resolved = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 7)], "group_id long, rule_id long")
    rows = [(1, 1, "error", "2026-01-01", 5, 0), (2, 1, "passed", "2026-01-02", 0, 0), (3, 2, "failed", "2026-01-01", 3, 0)]
    found = {r.group_id: tuple(r)[1:] for r in hierarchy.rollup(resolved, spark.createDataFrame(rows, RUN)).collect()}
    assert found == {1: ("failed", "2026-01-02", 3, 3), 2: ("failed", "2026-01-01", 3, 1), 3: (None, None, None, 0)}


TABLE = "source_key string, profiled_at timestamp, row_count long"
COLUMN = "source_key string, profiled_at timestamp, column string, null_rate double, distinct_count long, mean double, stddev double"


def snapshots(spark, tables, columns):
    def at(rows):
        return [("s", *row) for row in rows]

    cast = F.to_timestamp("profiled_at")
    t = spark.createDataFrame(at(tables), TABLE.replace("timestamp", "string")).withColumn("profiled_at", cast)
    c = spark.createDataFrame(at(columns), COLUMN.replace("timestamp", "string")).withColumn("profiled_at", cast)
    return t, c


def test_drift_between_two_snapshots(spark):
    before, now = "2026-07-01 10:00:00", "2026-07-02 10:00:00"
    t, c = snapshots(
        spark,
        [(before, 1000), (now, 600)],
        [
            (before, "id", 0.0, 1000, 500.0, 5.0), (before, "email", 0.01, 990, None, None), (before, "legacy", 0.0, 3, None, None),
            (now, "id", 0.0, 600, 900.0, 5.0), (now, "email", 0.25, 400, None, None), (now, "extra", 0.0, 600, None, None),
        ],
    )
    found = drift.drift(t, c)
    empty = found.limit(0).withColumn("seq", F.lit(0))
    listed = [(r.severity, r.column, r.kind) for r in drift.report(empty, found).collect()]
    assert listed == [
        ("high", None, "row_count"),
        ("high", "email", "null_rate"),
        ("medium", "legacy", "column_vanished"),
        ("medium", "email", "distinct_count"),
        ("medium", "id", "mean"),
        ("low", "extra", "column_appeared"),
    ]
    checks = {str(r.profiled_at): (r.finding_count, r.high_severity_count) for r in drift.check_history(t, found).collect()}
    assert checks == {before: (0, 0), now: (6, 2)}


def test_identical_snapshots_have_no_drift(spark):
    days = [f"2026-0{m}-01 00:00:00" for m in (1, 2, 3)]
    t, c = snapshots(spark, [(d, 100) for d in days], [(d, "id", 0.0, 100, 50.0, 10.0) for d in days])
    assert drift.drift(t, c).count() == 0


def test_previous_row_crosses_empty_slices(spark):
    days = ["2026-01-05", "2026-01-20", "2026-05-01", "2026-05-02", "2027-01-01"]
    df = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)], "k string, d string, v int").withColumn("d", F.to_timestamp("d"))
    found = with_previous(df, ["k"], "d", ["v"]).orderBy("v").collect()
    assert [r.prev_v for r in found] == [None, 0, 1, 2, 3]


def test_stripping_leaves_loops_and_what_lies_between(spark):
    loops = [(1, 2), (2, 1), (2, 5), (5, 3), (3, 4), (4, 3), (7, 7)]
    edges = spark.createDataFrame([*loops, *loops, (0, 1), (4, 6), (6, 8), (9, 0)], "parent_id long, child_id long")
    assert sorted(map(tuple, hierarchy.inner_edges(edges).collect())) == sorted(loops)
    assert sorted(r.group_id for r in hierarchy.groups_in_cycles(edges).collect()) == [1, 2, 3, 4, 7]
    assert hierarchy.groups_in_cycles(edges.filter("parent_id in (0, 9)")).isEmpty()


def test_loops_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (55, 2))]
    edges += [(100 + i, 100 + (i + 1) % 40) for i in range(40)]  # a loop of single nodes
    edges += [(200, 201), (201, 202), (202, 200), (200, 203), (203, 204), (204, 201), (204, 300), (300, 301), (301, 302), (302, 300), (400, 400), (401, 400), (500, 501), (501, 500)]
    follows = {}
    for a, b in edges:
        follows.setdefault(a, set()).add(b)

    def below(start):
        reached, todo = set(), [start]
        while todo:
            new = follows.get(todo.pop(), set()) - reached
            reached |= new
            todo += new
        return reached

    expected = {n for n in follows if n in below(n)}
    frame = spark.createDataFrame(edges, "parent_id long, child_id long")
    found = [r.group_id for r in hierarchy.groups_in_cycles(frame).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and {100, 139, 200, 203, 300, 400, 501} <= expected
    starts = spark.createDataFrame([(n,) for n in (0, 5, 100, 200, 401, 999)], "id long")
    pairs = sorted(tuple(r) for r in hierarchy.reachable(frame, starts).collect())
    assert pairs == sorted((s, n) for s in (0, 5, 100, 200, 401) for n in below(s))


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df, kept=hierarchy.cut_lineage: written.append(1) or kept(df))
    chain = spark.range(300).selectExpr("id AS parent_id", "id + 1 AS child_id")
    found = hierarchy.reachable(chain, spark.createDataFrame([(0,), (150,)], "id long"))
    assert found.groupBy("start_id").count().orderBy("start_id").collect() == [(0, 300), (150, 150)]
    assert len(written) <= 3 * 11
