"""Registered queries for drift, run history, rule groups and stored snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.examples.registry import registered, table
from plumbline.operators import drift as drifts
from plumbline.operators import hierarchy, history
from plumbline.operators.profile import snapshots_by
from plumbline.plans.durable import scratch
from plumbline.sources import stores

# --- drift ------------------------------------------------------------------------------------------------------


def event_snapshots(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Every event type is a source, every day a snapshot. Late in the month more values are NULL and values grow."""
    day = F.col("ts").cast("date").cast("timestamp")
    late = F.dayofmonth("ts") >= 25
    events = table(spark, path, "events").select(
        F.col("event_type").alias("source_key"),
        day.alias("profiled_at"),
        F.when(~late | (F.col("value") > 60), F.col("value") * F.when(F.dayofmonth("ts") == 20, 100).otherwise(1)).alias("value"),
        F.when(F.dayofmonth("ts") == 22, F.lit(1).cast("long")).otherwise(F.col("user_id")).alias("user_id"),
    )
    return snapshots_by(events, ["source_key", "profiled_at"])


EVENT_SNAPSHOTS = """
e AS (SELECT event_type AS source_key, ts::DATE AS day,
             CASE WHEN day(ts) < 25 OR value > 60 THEN value * CASE WHEN day(ts) = 20 THEN 100 ELSE 1 END END AS value,
             CASE WHEN day(ts) = 22 THEN 1 ELSE user_id END AS user_id FROM events),
t AS (SELECT source_key, day, count(*) AS rows FROM e GROUP BY ALL),
c AS (SELECT source_key, day, 'value' AS col, round_even(1 - count(value) / count(*), 6)::DOUBLE AS nulls, count(DISTINCT value) AS dist,
             avg(value) AS mean, stddev_samp(value) AS sd FROM e GROUP BY ALL
      UNION ALL SELECT source_key, day, 'user_id', round_even(1 - count(user_id) / count(*), 6)::DOUBLE, count(DISTINCT user_id),
             avg(user_id), stddev_samp(user_id) FROM e GROUP BY ALL),
l AS (SELECT *, lag(day) OVER w AS before, lag(rows) OVER w AS rows_before FROM t WINDOW w AS (PARTITION BY source_key ORDER BY day))"""
ROW_DRIFT = """
SELECT source_key, day, NULL AS col, 'row_count' AS kind, CASE WHEN abs((rows - rows_before) / rows_before) >= 0.3 THEN 'high' ELSE 'medium' END AS severity,
       rows::DOUBLE AS observed, rows_before::DOUBLE AS baseline FROM l WHERE abs((rows - rows_before) / rows_before) >= 0.1"""
COLUMN_DRIFT = """
SELECT p.source_key, p.day, p.col, f.kind, f.severity, f.observed, f.baseline FROM
  (SELECT n.*, b.nulls AS nulls0, b.dist AS dist0, b.mean AS mean0, b.sd AS sd0 FROM c n JOIN l ON n.source_key = l.source_key AND n.day = l.day
   JOIN c b ON b.source_key = l.source_key AND b.day = l.before AND b.col = n.col) p,
  LATERAL (VALUES
    ('null_rate', CASE WHEN nulls - nulls0 >= 0.1::DOUBLE THEN 'high' WHEN nulls - nulls0 >= 0.02::DOUBLE AND nulls > 3 * greatest(nulls0, 0.001::DOUBLE) THEN 'medium' END, nulls, nulls0),
    ('distinct_count', CASE WHEN dist < dist0 * 0.5 THEN 'medium' END, dist::DOUBLE, dist0::DOUBLE),
    ('mean', CASE WHEN sd0 <> 0 AND abs(mean - mean0) > 3 * sd0 THEN 'medium' END, mean, mean0)) AS f(kind, severity, observed, baseline)
WHERE f.severity IS NOT NULL"""


def _drift_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "source_key", F.col("profiled_at").cast("date").alias("day"), F.col("column").alias("col"), "kind", "severity",
        F.round("observed", 8).alias("observed"), F.round("baseline", 8).alias("baseline"),
    )


_ROUNDED = "SELECT source_key, day, col, kind, severity, round(observed, 8) AS observed, round(baseline, 8) AS baseline FROM"


@registered(f"WITH {EVENT_SNAPSHOTS} {_ROUNDED} ({ROW_DRIFT})")
def drift_rows(spark: SparkSession, path: str) -> DataFrame:
    return _drift_columns(drifts.drift(*event_snapshots(spark, path)).filter("kind = 'row_count'"))


@registered(f"WITH {EVENT_SNAPSHOTS} {_ROUNDED} ({COLUMN_DRIFT})")
def drift_null_distinct_mean(spark: SparkSession, path: str) -> DataFrame:
    return _drift_columns(drifts.drift(*event_snapshots(spark, path)).filter("kind <> 'row_count'"))


@registered(
    "WITH c AS (SELECT user_id::VARCHAR AS source_key, ts::DATE AS day, event_type AS col FROM events GROUP BY ALL), "
    "l AS (SELECT *, lag(day) OVER (PARTITION BY source_key ORDER BY day) AS before FROM (SELECT DISTINCT source_key, day FROM c)) "
    "SELECT l.source_key, l.day, b.col, 'column_vanished' AS kind, 'medium' AS severity FROM l JOIN c b ON b.source_key = l.source_key AND b.day = l.before "
    "WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.source_key = l.source_key AND c.day = l.day AND c.col = b.col) UNION ALL "
    "SELECT l.source_key, l.day, n.col, 'column_appeared', 'low' FROM l JOIN c n ON n.source_key = l.source_key AND n.day = l.day "
    "WHERE l.before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.source_key = l.source_key AND c.day = l.before AND c.col = n.col)"
)
def drift_columns(spark: SparkSession, path: str) -> DataFrame:
    """Users as sources; the event types a user causes on a day stand for the columns of that snapshot."""
    events = table(spark, path, "events").select(
        F.col("user_id").cast("string").alias("source_key"), F.col("ts").cast("date").cast("timestamp").alias("profiled_at"), "event_type"
    )
    tables = events.groupBy("source_key", "profiled_at").agg(F.count(F.lit(1)).alias("row_count"))
    unknown = F.lit(None).cast("double")
    columns = events.select("source_key", "profiled_at", F.col("event_type").alias("column")).distinct().withColumns(
        {"null_rate": F.lit(0.0), "distinct_count": F.lit(None).cast("long"), "mean": unknown, "stddev": unknown}
    )
    found = drifts.drift(tables, columns).filter(F.col("kind").startswith("column_"))
    return found.select("source_key", F.col("profiled_at").cast("date").alias("day"), F.col("column").alias("col"), "kind", "severity")


@registered(
    f"WITH {EVENT_SNAPSHOTS} SELECT row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 ELSE 1 END, kind <> 'row_count', col, "
    f"CASE kind WHEN 'null_rate' THEN 0 WHEN 'distinct_count' THEN 1 ELSE 2 END)::BIGINT AS place, col, kind, severity "
    f"FROM ({ROW_DRIFT} UNION ALL {COLUMN_DRIFT}) WHERE source_key = 'click' AND day = DATE '2024-01-25'"
)
def drift_report(spark: SparkSession, path: str) -> DataFrame:
    """The findings of one check in reading order. The place in the order is part of the result."""
    found = drifts.drift(*event_snapshots(spark, path))
    mine = found.filter((F.col("source_key") == "click") & (F.col("profiled_at") == F.lit("2024-01-25").cast("timestamp")))
    content = mine.limit(0).withColumn("seq", F.lit(0))
    ordered = drifts.report(content, mine)
    # One report is a few rows, so numbering them in one partition is safe.
    place = (F.monotonically_increasing_id() + 1).alias("place")
    return ordered.coalesce(1).select(place, F.col("column").alias("col"), "kind", "severity")


@registered(
    f"WITH {EVENT_SNAPSHOTS}, d AS ({ROW_DRIFT} UNION ALL {COLUMN_DRIFT}) "
    "SELECT t.source_key, t.day, t.rows AS row_count, count(d.kind) AS finding_count, count(*) FILTER (d.severity = 'high') AS high_severity_count "
    "FROM t LEFT JOIN d ON t.source_key = d.source_key AND t.day = d.day GROUP BY ALL"
)
def drift_history(spark: SparkSession, path: str) -> DataFrame:
    tables, columns = event_snapshots(spark, path)
    checked = drifts.check_history(tables, drifts.drift(tables, columns))
    return checked.select(
        "source_key", F.col("profiled_at").cast("date").alias("day"), "row_count", "finding_count", "high_severity_count"
    )


@registered(
    f"WITH {EVENT_SNAPSHOTS} SELECT source_key, day, rows AS row_count, 'latest' AS listed FROM t QUALIFY row_number() OVER (PARTITION BY source_key ORDER BY day DESC) = 1 "
    "UNION ALL SELECT source_key, day, rows, 'series' FROM (SELECT * FROM t WHERE source_key = 'view' ORDER BY day DESC LIMIT 50)"
)
def snapshot_latest(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots stored, read back, the newest per source and the series of one source."""
    where = scratch(spark, "snapshots")
    stores.append(event_snapshots(spark, path)[0], where, "load-1", partition_by=("source_key",))
    stored = stores.read(spark, where)
    day = F.col("profiled_at").cast("date").alias("day")
    latest = stores.latest_snapshots(stored).select("source_key", day, "row_count", F.lit("latest").alias("listed"))
    series = stores.snapshot_series(stored, "view").select("source_key", day, "row_count", F.lit("series").alias("listed"))
    return latest.unionByName(series)


# --- run history ------------------------------------------------------------------------------------------------


def event_runs(spark: SparkSession, path: str) -> DataFrame:
    """Each event as a rule run: its user is the rule, its type the outcome, its value failed rows and runtime."""
    failed = F.col("event_type").isin("click", "signup")
    return table(spark, path, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("rule_id"),
        F.when(failed, "failed").when(F.col("event_type") == "error", "error").otherwise("passed").alias("status"),
        F.when(F.col("value") < 200, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("not a time").alias("started_at"),
        F.when(failed, F.floor("value")).otherwise(0).cast("long").alias("failed_count"),
        F.when(F.col("event_type") != "error", F.floor(F.col("value") * 10)).cast("long").alias("runtime_ms"),
        F.when(F.col("event_type") != "view", "scheduler").otherwise("someone").alias("executed_by"),
        F.when(F.col("value") >= 20, F.length("event_type")).cast("long").alias("schedule_id"),
    )


EVENT_RUNS = """
r AS (SELECT event_id AS id, user_id AS rule_id, CASE WHEN event_type IN ('click', 'signup') THEN 'failed' WHEN event_type = 'error' THEN 'error' ELSE 'passed' END AS status,
             CASE WHEN value < 200 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE 'not a time' END AS started_at,
             CASE WHEN event_type IN ('click', 'signup') THEN floor(value)::BIGINT ELSE 0 END AS failed_count,
             CASE WHEN event_type <> 'error' THEN floor(value * 10)::BIGINT END AS runtime_ms,
             CASE WHEN event_type <> 'view' THEN 'scheduler' ELSE 'someone' END AS executed_by,
             CASE WHEN value >= 20 THEN length(event_type)::BIGINT END AS schedule_id FROM events)"""


@registered(
    f"WITH {EVENT_RUNS} SELECT day, round_even(passed / nullif(passed + failed, 0) * 100, 1)::DOUBLE AS pass_rate, volume, failed_rows::BIGINT AS failed_rows, mean_runtime_ms FROM ("
    "SELECT coalesce(try_cast(started_at AS TIMESTAMP)::DATE::VARCHAR, 'Unknown') AS day, count(*) FILTER (status = 'passed') AS passed, "
    "count(*) FILTER (status = 'failed') AS failed, count(*) AS volume, sum(failed_count) AS failed_rows, round_even(avg(runtime_ms), 0)::BIGINT AS mean_runtime_ms "
    "FROM r GROUP BY 1 ORDER BY 1 DESC LIMIT 30)"
)
def history_daily(spark: SparkSession, path: str) -> DataFrame:
    return history.daily(event_runs(spark, path))


@registered(
    f"WITH {EVENT_RUNS} SELECT count(*) AS runs, count(*) FILTER (status <> 'passed') AS failures, "
    "round_even(count(*) FILTER (status = 'passed') / count(*) FILTER (status <> 'error') * 100, 0)::DOUBLE AS pass_rate FROM (SELECT * FROM r ORDER BY id DESC LIMIT 100)"
)
def history_overview(spark: SparkSession, path: str) -> DataFrame:
    return history.overview(event_runs(spark, path))


@registered(f"WITH {EVENT_RUNS} SELECT status, count(*) AS runs FROM r GROUP BY 1")
def history_status(spark: SparkSession, path: str) -> DataFrame:
    return history.outcomes(event_runs(spark, path))


@registered(
    f"WITH {EVENT_RUNS} SELECT rule_id, failed_count FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY id DESC) = 1) "
    "WHERE failed_count > 0 ORDER BY failed_count DESC, id LIMIT 8"
)
def history_top_failing(spark: SparkSession, path: str) -> DataFrame:
    return history.top_failing(event_runs(spark, path))


@registered(
    f"WITH {EVENT_RUNS} SELECT rule_id, mean_runtime_ms FROM (SELECT rule_id, round_even(avg(runtime_ms), 0)::BIGINT AS mean_runtime_ms, max(id) AS id "
    "FROM r WHERE runtime_ms IS NOT NULL GROUP BY 1) ORDER BY mean_runtime_ms DESC, id LIMIT 8"
)
def history_slowest(spark: SparkSession, path: str) -> DataFrame:
    return history.slowest(event_runs(spark, path))


@registered(
    f"WITH {EVENT_RUNS} SELECT coalesce(try_cast(started_at AS TIMESTAMP)::DATE::VARCHAR, 'Unknown') AS day, count(*) FILTER (status = 'passed') AS passed, "
    "count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'error') AS error FROM r WHERE rule_id = 8 GROUP BY 1 ORDER BY 1 DESC LIMIT 14"
)
def history_rule_outcomes(spark: SparkSession, path: str) -> DataFrame:
    return history.rule_outcomes(event_runs(spark, path), 8)


@registered(f"WITH {EVENT_RUNS} SELECT started_at, failed_count FROM r WHERE rule_id = 8 AND status <> 'error'")
def history_failed_rows(spark: SparkSession, path: str) -> DataFrame:
    return history.failed_row_series(event_runs(spark, path), 8)


@registered(
    f"WITH {EVENT_RUNS} SELECT schedule_id, count(*) AS runs, count(*) FILTER (status = 'passed') AS passed, count(*) FILTER (status = 'failed') AS failed, "
    "count(*) FILTER (status = 'error') AS errored, max(started_at) AS last_run, round_even(count(*) FILTER (status = 'passed') / count(*) * 100, 1)::DOUBLE AS pass_rate "
    "FROM r WHERE executed_by = 'scheduler' AND schedule_id IS NOT NULL GROUP BY 1"
)
def history_schedule(spark: SparkSession, path: str) -> DataFrame:
    return history.schedule_statistics(event_runs(spark, path))


@registered(
    f"WITH {EVENT_RUNS} SELECT id, rule_id, status FROM r WHERE executed_by = 'scheduler' AND schedule_id = 5 ORDER BY started_at DESC, id DESC LIMIT 50"
)
def history_schedule_executions(spark: SparkSession, path: str) -> DataFrame:
    return history.schedule_executions(event_runs(spark, path), 5).select("id", "rule_id", "status")


@registered(
    f"WITH {EVENT_RUNS}, b AS (SELECT rule_id, schedule_id, max(CASE status WHEN 'error' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END) AS s FROM r WHERE schedule_id IS NOT NULL GROUP BY ALL) "
    "SELECT x.rule_id, y.schedule_id, CASE coalesce(s, 2) WHEN 2 THEN 'error' WHEN 1 THEN 'failed' ELSE 'passed' END AS status "
    "FROM (SELECT DISTINCT rule_id FROM r) x, (VALUES (4::BIGINT), (5), (6), (8)) y(schedule_id) LEFT JOIN b ON b.rule_id = x.rule_id AND b.schedule_id = y.schedule_id"
)
def history_batch_status(spark: SparkSession, path: str) -> DataFrame:
    runs = event_runs(spark, path)
    expected = runs.select("rule_id", F.explode(F.array(*(F.lit(n).cast("long") for n in (4, 5, 6, 8)))).alias("schedule_id"))
    return history.batch_status(runs.filter("schedule_id IS NOT NULL"), ["rule_id", "schedule_id"], expected)


@registered(f"WITH {EVENT_RUNS} SELECT * EXCLUDE (executed_by) FROM r ORDER BY id DESC LIMIT 1000")
def history_latest_runs(spark: SparkSession, path: str) -> DataFrame:
    where = scratch(spark, "runs")
    stores.append(event_runs(spark, path), where, "load-1", partition_by=("executed_by",))
    return stores.latest_runs(stores.read(spark, where), 1000).drop("executed_by", "batch")


# --- rule groups ------------------------------------------------------------------------------------------------

# Regions, nations and customers form a tree of groups; a customer's orders are the rules of its group.
# Ids: region r is -1000-r, nation n is -1-n, customer c is c.


def group_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nation, customer, orders = (table(spark, path, name) for name in ("nation", "customer", "orders"))
    region_id, nation_id = -1000 - F.col("n_regionkey").cast("long"), -1 - F.col("n_nationkey").cast("long")
    edges = nation.select(region_id.alias("parent_id"), nation_id.alias("child_id")).unionByName(
        customer.select((-1 - F.col("c_nationkey").cast("long")).alias("parent_id"), F.col("c_custkey").alias("child_id"))
    )
    known_customers = customer.filter("c_acctbal >= 0").select(F.col("c_custkey").alias("id"))
    groups = (
        nation.select(region_id.alias("id")).distinct().unionByName(nation.select(nation_id.alias("id"))).unionByName(known_customers)
    )
    members = orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("rule_id"))
    rules = orders.filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("id"))
    return edges, groups, members, rules


GROUP_TABLES = """
edges AS (SELECT -1000 - n_regionkey::BIGINT AS parent_id, -1 - n_nationkey::BIGINT AS child_id FROM nation UNION ALL SELECT -1 - c_nationkey::BIGINT, c_custkey FROM customer),
grp AS (SELECT DISTINCT -1000 - n_regionkey::BIGINT AS id FROM nation UNION ALL SELECT -1 - n_nationkey FROM nation UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal >= 0),
members AS (SELECT o_custkey AS group_id, o_orderkey AS rule_id FROM orders),
closed AS (SELECT id AS start_id, id AS group_id FROM grp UNION
           SELECT c.start_id, e.child_id FROM closed c JOIN edges e ON e.parent_id = c.group_id WHERE e.child_id IN (SELECT id FROM grp))"""


@registered(f"WITH RECURSIVE {GROUP_TABLES} SELECT start_id, group_id FROM closed")
def group_closure(spark: SparkSession, path: str) -> DataFrame:
    edges, groups, _, _ = group_tables(spark, path)
    return hierarchy.closure(edges, groups)


@registered(
    f"WITH RECURSIVE {GROUP_TABLES}, known AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'), "
    "m AS (SELECT c.start_id, count(k.id) AS rules, count(*) - count(k.id) AS missing FROM closed c JOIN members USING (group_id) LEFT JOIN known k ON k.id = rule_id GROUP BY 1), "
    "g AS (SELECT c.start_id, count(*) AS missing FROM closed c JOIN edges e ON e.parent_id = c.group_id WHERE e.child_id NOT IN (SELECT id FROM grp) GROUP BY 1) "
    "SELECT grp.id AS group_id, coalesce(m.rules, 0) AS rules, coalesce(m.missing, 0) AS missing_rules, coalesce(g.missing, 0) AS missing_groups "
    "FROM grp LEFT JOIN m ON m.start_id = grp.id LEFT JOIN g ON g.start_id = grp.id"
)
def group_resolution(spark: SparkSession, path: str) -> DataFrame:
    edges, groups, members, rules = group_tables(spark, path)
    return hierarchy.resolve(hierarchy.closure(edges, groups), edges, members, groups, rules)


@registered(
    f"WITH RECURSIVE {GROUP_TABLES}, looped AS (SELECT * FROM edges UNION ALL SELECT c_custkey, -1 - c_nationkey::BIGINT FROM customer WHERE c_acctbal > 9000), "
    "reach AS (SELECT parent_id AS start_id, child_id AS group_id FROM looped UNION SELECT r.start_id, e.child_id FROM reach r JOIN looped e ON e.parent_id = r.group_id) "
    "SELECT DISTINCT group_id FROM reach WHERE start_id = group_id"
)
def group_cycles(spark: SparkSession, path: str) -> DataFrame:
    """Rich customers contain their own nation, which closes loops."""
    edges = group_tables(spark, path)[0]
    loops = table(spark, path, "customer").filter("c_acctbal > 9000").select(
        F.col("c_custkey").alias("parent_id"), (-1 - F.col("c_nationkey").cast("long")).alias("child_id")
    )
    return hierarchy.groups_in_cycles(edges.unionByName(loops))


@registered(
    "SELECT c_custkey AS group_id, -1 - c_nationkey::BIGINT AS ancestor_id FROM customer UNION ALL "
    "SELECT c_custkey, -1000 - n_regionkey::BIGINT FROM customer JOIN nation ON c_nationkey = n_nationkey"
)
def group_ancestors(spark: SparkSession, path: str) -> DataFrame:
    edges = group_tables(spark, path)[0]
    return hierarchy.ancestors(edges, table(spark, path, "customer").select(F.col("c_custkey").alias("id")))


@registered(
    f"WITH RECURSIVE {GROUP_TABLES}, latest AS (SELECT o_custkey AS rule_id, count(*) OVER (PARTITION BY o_custkey) AS runs, "
    "CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END AS s, o_orderdate, length(o_orderpriority) AS failed FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) "
    "SELECT c.start_id AS group_id, CASE max(s) WHEN 2 THEN 'error' WHEN 1 THEN 'failed' WHEN 0 THEN 'passed' END AS last_status, max(o_orderdate) AS last_run, "
    "sum(failed)::BIGINT AS last_failed, coalesce(sum(runs), 0)::BIGINT AS runs FROM closed c LEFT JOIN latest l ON l.rule_id = c.group_id "
    "WHERE c.group_id >= 0 GROUP BY 1"
)
def group_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Customers are the rules here, their orders the runs; nations and regions roll them up."""
    edges, groups, _, _ = group_tables(spark, path)
    customers = groups.filter("id >= 0")
    members = customers.select(F.col("id").alias("group_id"), F.col("id").alias("rule_id"))
    resolved = hierarchy.group_rules(hierarchy.closure(edges, groups), members, customers)
    status = F.when(F.col("o_orderstatus") == "F", "error").when(F.col("o_orderstatus") == "O", "failed").otherwise("passed")
    runs = table(spark, path, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("rule_id"), status.alias("status"),
        F.col("o_orderdate").alias("started_at"), F.length("o_orderpriority").cast("long").alias("failed_count"),
    )
    return hierarchy.rollup(resolved, runs)
