"""Registered queries for rules, batches and evidence."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.examples.registry import AS_OF, folder, registered, rule, table
from plumbline.operators.keys import KeyedComparison
from plumbline.plans import runner
from plumbline.plans.durable import scratch
from plumbline.plans.written import write_checked
from plumbline.sources import catalog, stores
from plumbline.spec import Rule


def failing(spark: SparkSession, path: str, checked: Rule) -> DataFrame:
    return runner.failing_rows(spark, checked, folder(path), AS_OF)


ORDERS_WITH_GAPS = "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders"
TEXT_DATES = """
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN date_format(o_orderdate, 'dd/MM/yyyy')
                            WHEN '2-HIGH' THEN date_format(o_orderdate, 'yyyy/MM/dd')
                            WHEN '3-MEDIUM' THEN date_format(o_orderdate, 'yyyy-MM-dd HH:mm:ss')
                            WHEN '4-NOT SPECIFIED' THEN nullif(o_orderpriority, '4-NOT SPECIFIED')
                            ELSE date_format(o_orderdate, 'yyyy-MM-dd') END AS ordered
FROM orders"""
TEXT_DATES_ORACLE = """
SELECT o_orderkey,
       CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%d/%m/%Y')
                            WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y/%m/%d')
                            WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')
                            WHEN '4-NOT SPECIFIED' THEN NULL
                            ELSE strftime(o_orderdate, '%Y-%m-%d') END AS ordered
FROM orders"""
SMALL_PARTS = "SELECT * FROM part WHERE p_size <= 40"
PADDED_SUPPLIERS = "SELECT l_orderkey, l_linenumber, concat('  ', l_suppkey, ' ') AS supplier FROM lineitem"
RICH_SUPPLIERS = "SELECT concat(' ', s_suppkey) AS supplier FROM supplier WHERE s_acctbal > 0"
CHANGED_SEGMENTS = (
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN nullif(c_mktsegment, 'MACHINERY') ELSE c_mktsegment END AS c_mktsegment, "
    "c_nationkey FROM customer"
)


@registered("SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def rule_not_null(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "not_null", ORDERS_WITH_GAPS, column="o_orderstatus"))


@registered("SELECT * FROM customer WHERE c_acctbal < 0 OR c_acctbal > 5000.5")
def rule_value_range(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "value_range", "customer", column="c_acctbal", min=0, max=5000.5))


@registered(r"SELECT * FROM part WHERE NOT regexp_matches(p_name, '^(small|red|large)\s[a-m]\w+$')")
def rule_regex(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "regex", "part", column="p_name", pattern=r"^(small|red|large)\s[a-m]\w+$"))


@registered("SELECT * FROM part WHERE length(p_name) < 8 OR length(p_name) > 10")
def rule_length(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "length", "part", column="p_name", min_length=8, max_length=10))


@registered(
    "SELECT o_orderkey, scaled FROM (SELECT o_orderkey, o_totalprice * 1000.0 AS scaled FROM orders) "
    "WHERE length(CAST(scaled AS VARCHAR)) < 10 OR length(CAST(scaled AS VARCHAR)) > 11"
)
def rule_length_of_numbers(spark: SparkSession, path: str) -> DataFrame:
    scaled = "SELECT o_orderkey, o_totalprice * 1000D AS scaled FROM orders"
    return failing(spark, path, rule(1, "length", scaled, column="scaled", min_length=10, max_length=11))


@registered("SELECT event_id, event_type, value FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def rule_allowed_values(spark: SparkSession, path: str) -> DataFrame:
    wanted = rule(1, "allowed_values", "events", column="event_type", values=["click", "view", "purchase"])
    return failing(spark, path, wanted).select("event_id", "event_type", "value")


@registered(
    f"SELECT * FROM ({TEXT_DATES_ORACLE}) WHERE ordered IS NULL OR try_cast(ordered AS DATE) IS NULL "
    "OR try_cast(ordered AS DATE) < DATE '1996-01-01' OR try_cast(ordered AS DATE) > DATE '2000-12-31'"
)
def rule_date_validity(spark: SparkSession, path: str) -> DataFrame:
    bounds = {"min_date": "1996-01-01", "max_date": "2000-12-31"}
    return failing(spark, path, rule(1, "date_validity", TEXT_DATES, column="ordered", **bounds))


@registered("SELECT event_id, ts FROM events WHERE ts < DATE '2024-01-03' OR ts > DATE '2024-01-28'")
def rule_date_validity_timestamps(spark: SparkSession, path: str) -> DataFrame:
    bounds = {"min_date": "2024-01-03", "max_date": "2024-01-28"}
    return failing(spark, path, rule(1, "date_validity", "events", column="ts", **bounds)).select("event_id", "ts")


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem "
    "QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1"
)
def rule_unique(spark: SparkSession, path: str) -> DataFrame:
    keyed = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem"
    return failing(spark, path, rule(1, "unique", keyed, columns=["l_orderkey", "l_linenumber"]))


@registered(
    "SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders WHERE o_orderstatus <> 'F' "
    "QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1"
)
def rule_unique_null_keys(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "unique", ORDERS_WITH_GAPS, columns=["o_custkey", "o_orderstatus"]))


@registered("SELECT doc_id, lang, source FROM documents QUALIFY count(*) OVER (PARTITION BY text) > 1")
def rule_duplicate(spark: SparkSession, path: str) -> DataFrame:
    return failing(spark, path, rule(1, "duplicate", "documents", column="text")).select("doc_id", "lang", "source")


@registered(
    "SELECT 1::BIGINT AS rule_id, count(*) AS checked_count, (count(*) < 20)::BIGINT AS failed_count FROM orders UNION ALL "
    "SELECT 2, count(*), (count(*) > 100)::BIGINT FROM lineitem"
)
def rule_row_count(spark: SparkSession, path: str) -> DataFrame:
    rules = [rule(1, "row_count", "orders", min_count=20), rule(2, "row_count", "lineitem", max_count=100)]
    return runner.summarise(spark, rules, folder(path)).select("rule_id", "checked_count", "failed_count")


@registered(
    "WITH latest AS ("
    "SELECT 1::BIGINT AS rule_id, count(*) AS checked_count, max(ts) AS latest_value, 1 AS days FROM events UNION ALL "
    "SELECT 2, count(*), max(ts), 5 FROM events UNION ALL "
    "SELECT 3, count(*), strptime(max(strftime(o_orderdate, '%d/%m/%Y')), '%d/%m/%Y'), 5 FROM orders) "
    "SELECT rule_id, checked_count, "
    "(latest_value + to_days(days) < TIMESTAMP '2024-02-01')::BIGINT AS failed_count, latest_value, "
    "round_even(greatest(epoch_us(TIMESTAMP '2024-02-01') - epoch_us(latest_value), 0) / 86400000000.0, 2)::DOUBLE "
    "AS freshness_age_days, days AS max_age_days FROM latest"
)
def rule_freshness(spark: SparkSession, path: str) -> DataFrame:
    rules = [
        rule(1, "data_freshness", "events", column="ts", max_age_days=1),
        rule(2, "data_freshness", "events", column="ts", max_age_days=5),
        rule(3, "data_freshness", "SELECT date_format(o_orderdate, 'dd/MM/yyyy') AS d FROM orders", column="d", max_age_days=5),
    ]
    return runner.summarise(spark, rules, folder(path), AS_OF).select(
        "rule_id", "checked_count", "failed_count", F.col("latest_value").cast("timestamp_ntz").alias("latest_value"),
        "freshness_age_days", "max_age_days",
    )


@registered(
    "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem "
    "WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)"
)
def rule_referential(spark: SparkSession, path: str) -> DataFrame:
    keyed = "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem"
    wanted = rule(1, "referential_integrity", keyed, source_key="l_partkey", target=SMALL_PARTS, target_key="p_partkey")
    return failing(spark, path, wanted)


@registered(
    "SELECT l_orderkey, l_linenumber, concat('  ', l_suppkey, ' ') AS supplier FROM lineitem "
    "WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"
)
def rule_referential_text_key(spark: SparkSession, path: str) -> DataFrame:
    wanted = rule(
        1, "referential_integrity", PADDED_SUPPLIERS, source_key="SUPPLIER", target=RICH_SUPPLIERS, target_key="supplier"
    )
    return failing(spark, path, wanted)


@registered(
    "SELECT s.*, count(*) AS mismatch_count FROM (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer) s "
    "JOIN (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN nullif(c_mktsegment, 'MACHINERY') ELSE c_mktsegment END AS "
    "c_mktsegment, c_nationkey FROM customer) t USING (c_custkey) "
    "WHERE coalesce(s.c_mktsegment, '') <> coalesce(t.c_mktsegment, '') OR s.c_nationkey <> t.c_nationkey GROUP BY ALL"
)
def rule_keyed_comparison(spark: SparkSession, path: str) -> DataFrame:
    wanted = rule(
        1, "keyed_comparison", "SELECT c_custkey, c_mktsegment, c_nationkey FROM customer", target=CHANGED_SEGMENTS,
        key_column="c_custkey", compare_columns=["c_mktsegment", "c_nationkey"], target_relation="changed",
    )
    return failing(spark, path, wanted)


@registered(
    "SELECT (SELECT count(*) FROM orders) AS checked_count, count(*) FILTER ("
    "coalesce(nullif(s.o_orderstatus, 'F'), '') <> t.o_orderstatus OR s.o_orderpriority <> t.o_orderpriority) AS failed_count "
    "FROM orders s JOIN orders t USING (o_custkey)"
)
def keyed_comparison_repeated_keys(spark: SparkSession, path: str) -> DataFrame:
    orders = table(spark, path, "orders")
    gaps = orders.withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("F")))
    return KeyedComparison(gaps, "o_custkey", ["o_orderstatus", "o_orderpriority"], orders).counts()


@registered("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 AND o_orderstatus = 'F'")
def rule_custom_fail_rows(spark: SparkSession, path: str) -> DataFrame:
    sql = "SELECT o_orderkey, o_totalprice FROM dataset_view WHERE o_totalprice > 400000 AND o_orderstatus = 'F';"
    return failing(spark, path, rule(1, "custom_sql_fail_rows", "orders", sql=sql))


@registered(
    "SELECT c_nationkey, value FROM (SELECT c_nationkey, count(*) AS value FROM customer GROUP BY 1) WHERE value >= 50"
)
def rule_custom_threshold(spark: SparkSession, path: str) -> DataFrame:
    sql = "SELECT c_nationkey, count(*) AS value FROM dataset_view GROUP BY c_nationkey"
    return failing(spark, path, rule(1, "custom_sql_threshold", "customer", sql=sql, operator=">=", threshold="50"))


CONNECTION_SQL = (
    "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey "
    "JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_acctbal < 0 AND o.o_orderstatus = 'P'"
)


@registered(CONNECTION_SQL)
def rule_whole_connection(spark: SparkSession, path: str) -> DataFrame:
    wanted = rule(1, "custom_sql_connection", "orders", sql=CONNECTION_SQL, source_kind="connection")
    return failing(spark, path, wanted)


def batch_rules() -> list[Rule]:
    """Seven rules on orders that share a scan, and one of every other kind."""
    return [
        rule(1, "not_null", "orders", column="o_custkey"),
        rule(2, "value_range", "orders", column="o_totalprice", min=1000, max=450000, fail_threshold_percent=12.5),
        rule(3, "regex", "orders", column="o_orderpriority", pattern="^[1-3]-"),
        rule(4, "length", "orders", column="o_orderpriority", min_length=5, max_length=10),
        rule(5, "allowed_values", "orders", column="o_orderstatus", values=["O", "P"], fail_threshold_count=3),
        rule(6, "date_validity", "orders", column="o_orderdate", min_date="1996-01-01"),
        rule(7, "row_count", "orders", min_count=1),
        rule(8, "data_freshness", "events", column="ts", max_age_days=1),
        rule(9, "unique", "orders", columns=["o_orderkey"]),
        rule(10, "duplicate", "orders", columns=["o_custkey"], fail_threshold_percent=100),
        rule(11, "referential_integrity", "lineitem", source_key="l_partkey", target=SMALL_PARTS, target_key="p_partkey"),
        rule(
            12, "keyed_comparison", "customer", target=CHANGED_SEGMENTS, key_column="c_custkey",
            compare_columns=["c_mktsegment"], target_relation="changed",
        ),
        rule(13, "custom_sql_fail_rows", "customer", sql="SELECT * FROM dataset_view WHERE c_acctbal < 0"),
        rule(14, "custom_sql_threshold", "customer", sql="SELECT avg(c_acctbal) AS value FROM dataset_view", threshold=100),
        rule(15, "custom_sql_connection", "orders", sql=CONNECTION_SQL, source_kind="connection"),
        rule(16, "not_null", "orders", column="no_such_column"),
        rule(17, "allowed_values", "orders", column="o_orderstatus", values="O"),
    ]


# Written out independently: one statement per rule, each over the whole table.
BATCH_COUNTS = """
WITH counts(rule_id, checked_count, failed_count, allowed) AS (
  SELECT 1, count(*), count(*) FILTER (o_custkey IS NULL), 0 FROM orders
  UNION ALL SELECT 2, count(*), count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 450000), floor(count(*) * 12.5 / 100) FROM orders
  UNION ALL SELECT 3, count(*), count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-')), 0 FROM orders
  UNION ALL SELECT 4, count(*), count(*) FILTER (length(o_orderpriority) NOT BETWEEN 5 AND 10), 0 FROM orders
  UNION ALL SELECT 5, count(*), count(*) FILTER (o_orderstatus NOT IN ('O', 'P')), 3 FROM orders
  UNION ALL SELECT 6, count(*), count(*) FILTER (o_orderdate < DATE '1996-01-01'), 0 FROM orders
  UNION ALL SELECT 7, count(*), 0, 0 FROM orders
  UNION ALL SELECT 8, count(*), (max(ts) + INTERVAL 1 DAY < TIMESTAMP '2024-02-01')::BIGINT, 0 FROM events
  UNION ALL SELECT 9, count(*), count(*) FILTER (n > 1), 0 FROM (SELECT count(*) OVER (PARTITION BY o_orderkey) AS n FROM orders)
  UNION ALL SELECT 10, count(*), count(*) FILTER (n > 1), count(*) FROM (SELECT count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
  UNION ALL SELECT 11, count(*), count(*) FILTER (l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)), 0 FROM lineitem
  UNION ALL SELECT 12, count(*), count(*) FILTER (c_acctbal < 0 AND c_mktsegment = 'MACHINERY'), 0 FROM customer
  UNION ALL SELECT 13, count(*), count(*) FILTER (c_acctbal < 0), 0 FROM customer
  UNION ALL SELECT 14, count(*), (avg(c_acctbal) > 100)::BIGINT, 0 FROM customer
  UNION ALL SELECT 15, count(*), count(*), 0 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
            WHERE c.c_acctbal < 0 AND o.o_orderstatus = 'P'
  UNION ALL SELECT 16, 0, 0, NULL
  UNION ALL SELECT 17, 0, 0, NULL
)"""


@registered(
    BATCH_COUNTS + " SELECT rule_id::BIGINT AS rule_id, checked_count::BIGINT AS checked_count, "
    "failed_count::BIGINT AS failed_count, nullif(allowed, 0)::BIGINT AS fail_threshold_allowed, "
    "CASE WHEN allowed IS NULL THEN 'error' WHEN failed_count <= allowed THEN 'passed' ELSE 'failed' END AS status FROM counts"
)
def run_batch_summary(spark: SparkSession, path: str) -> DataFrame:
    return runner.summarise(spark, batch_rules(), folder(path), AS_OF).select(
        "rule_id", "checked_count", "failed_count", "fail_threshold_allowed", "status"
    )


@registered(
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_quantity, l_discount, l_returnflag, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n "
    "FROM lineitem WHERE l_quantity > 5) SELECT t.*, CASE WHEN t.failed_count = 0 THEN 'passed' ELSE 'failed' END AS status FROM (SELECT count(*) AS rows_written, "
    "count(*) FILTER (l_quantity > 45) AS f1, count(*) FILTER (l_returnflag NOT IN ('A', 'N')) AS f2, "
    "(max(l_shipdate) + INTERVAL 1 DAY < TIMESTAMP '2024-02-01')::BIGINT AS f4, count(*) FILTER (n > 1) AS f5, "
    "count(*) FILTER (l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) AS f6 FROM c), LATERAL (VALUES "
    "(1::BIGINT, rows_written, f1), (2, rows_written, f2), (3, rows_written, 0), (4, rows_written, f4), (5, rows_written, f5), (6, rows_written, f6)) "
    "AS t(rule_id, checked_count, failed_count)"
)
def write_checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Order lines written once; the writing tasks count for rules 1 to 4, keys and references read what was written."""
    rules = [
        rule(1, "value_range", "lineitem", column="l_quantity", min=0, max=45),
        rule(2, "allowed_values", "lineitem", column="l_returnflag", values=["A", "N"]),
        rule(3, "row_count", "lineitem", min_count=1),
        rule(4, "data_freshness", "lineitem", column="l_shipdate", max_age_days=1),
        rule(5, "unique", "lineitem", columns=["l_orderkey", "l_linenumber"]),
        rule(
            6, "referential_integrity", "lineitem", source_key="l_orderkey", target_key="o_orderkey",
            target="SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P'",
        ),
    ]
    lines = table(spark, path, "lineitem").filter("l_quantity > 5")
    result = write_checked(lines, scratch(spark, "lines"), rules, folder(path), as_of=AS_OF)
    return result.runs.select("rule_id", "checked_count", "failed_count", "status")


@registered(
    BATCH_COUNTS + " SELECT rule_id::BIGINT AS rule_id, least(failed_count, 500)::BIGINT AS evidence_rows "
    "FROM counts WHERE failed_count > 0"
)
def run_batch_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Run the batch for real, store its evidence and count what was stored."""
    result = runner.run_rules(spark, batch_rules(), folder(path), as_of=AS_OF)
    where = scratch(spark, "evidence")
    stores.append(result.evidence, where, "batch-1", partition_by=("rule_id",))
    return stores.read(spark, where).groupBy(F.col("rule_id").cast("long").alias("rule_id")).agg(
        F.count("row_json").alias("evidence_rows")
    )


@registered(
    "SELECT 1::BIGINT AS rule_id, 'passed' AS status, count(*) AS checked_count, 0::BIGINT AS failed_count, FALSE AS explained FROM orders "
    "UNION ALL SELECT 2, 'error', 0, 0, TRUE UNION ALL "
    "SELECT 3, 'failed', count(*), count(*) FILTER (o_orderstatus NOT IN ('O', 'P')), FALSE FROM orders "
    "UNION ALL SELECT 4, 'passed', count(*), 0, FALSE FROM customer UNION ALL SELECT 5, 'error', 0, 0, TRUE UNION ALL "
    "SELECT 6, 'failed', count(*), count(*) FILTER (c_acctbal < 0), FALSE FROM customer"
)
def run_batch_errors(spark: SparkSession, path: str) -> DataFrame:
    """Rules 2 and 5 fail while they run: one within a shared scan, one as a query of its own. The others are unharmed."""
    rules = [
        rule(1, "not_null", "orders", column="o_custkey"),
        rule(2, "value_range", "orders", column="o_orderpriority", min=0, max=1),
        rule(3, "allowed_values", "orders", column="o_orderstatus", values=["O", "P"]),
        rule(4, "unique", "customer", columns=["c_custkey"]),
        rule(5, "custom_sql_fail_rows", "customer", sql="SELECT * FROM dataset_view WHERE CAST(c_name AS INT) > 0"),
        rule(6, "value_range", "customer", column="c_acctbal", min=0, max=1_000_000),
    ]
    runs = runner.run_rules(spark, rules, folder(path), as_of=AS_OF).runs
    return runs.select("rule_id", "status", "checked_count", "failed_count", F.col("error").isNotNull().alias("explained"))


@registered(
    "SELECT t.rule_id, n AS failed_count, t.allowed::BIGINT AS fail_threshold_allowed, "
    "CASE WHEN n <= coalesce(t.allowed, 0) THEN 'passed' ELSE 'failed' END AS status FROM "
    "(SELECT count(*) FILTER (c_acctbal < 0) AS n, count(*) AS total FROM customer) c, LATERAL (VALUES "
    "(1::BIGINT, NULL::DOUBLE), (2, 5), (3, 1000000), (4, nullif(floor(total * 7.5 / 100), 0)), "
    "(5, nullif(floor(total * 50 / 100), 0)), (6, greatest(5, floor(total * 1.5 / 100))), (7, NULL)) AS t(rule_id, allowed)"
)
def run_tolerance(spark: SparkSession, path: str) -> DataFrame:
    settings = [
        {}, {"fail_threshold_count": 5}, {"fail_threshold_count": "1000000"}, {"fail_threshold_percent": 7.5},
        {"fail_threshold_percent": 50}, {"fail_threshold_count": 5, "fail_threshold_percent": "1.5"},
        {"fail_threshold_count": "", "fail_threshold_percent": 0},
    ]
    rules = [
        rule(i, "value_range", "customer", column="c_acctbal", min=0, max=1_000_000, **tolerance)
        for i, tolerance in enumerate(settings, 1)
    ]
    return runner.summarise(spark, rules, folder(path)).select("rule_id", "failed_count", "fail_threshold_allowed", "status")


@registered(
    "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus = 'F' THEN 1 END, "
    "CASE WHEN o_totalprice > 300000 THEN 2 END, CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-3]-') THEN 3 END], "
    "lambda x: x IS NOT NULL), ',') AS violated FROM orders "
    "WHERE o_orderstatus = 'F' OR o_totalprice > 300000 OR NOT regexp_matches(o_orderpriority, '^[1-3]-')"
)
def record_scorecard(spark: SparkSession, path: str) -> DataFrame:
    rules = [
        rule(1, "allowed_values", "orders", column="o_orderstatus", values=["O", "P"]),
        rule(2, "value_range", "orders", column="o_totalprice", min=0, max=300000),
        rule(3, "regex", "orders", column="o_orderpriority", pattern="^[1-3]-"),
    ]
    scored = runner.scorecard(table(spark, path, "orders"), rules)
    return scored.select("o_orderkey", F.array_join(F.col("violated_rules").cast("array<string>"), ",").alias("violated"))


@registered(
    "SELECT * FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') "
    "OR contains(lower(p_type), 'ring')"
)
def evidence_search(spark: SparkSession, path: str) -> DataFrame:
    return stores.search_evidence(table(spark, path, "part"), " RING ", shown=None)


@registered(
    "SELECT l_orderkey, l_partkey FROM lineitem "
    "WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40) AND contains(l_partkey::VARCHAR, '17')"
)
def evidence_round_trip(spark: SparkSession, path: str) -> DataFrame:
    """All failing rows stored as JSON evidence, read back for one run, widened and searched."""
    at = datetime(2024, 2, 1, 12, tzinfo=timezone.utc)
    keyed = "SELECT l_orderkey, l_partkey FROM lineitem"
    wanted = rule(7, "referential_integrity", keyed, source_key="l_partkey", target=SMALL_PARTS, target_key="p_partkey")
    rows = failing(spark, path, wanted)
    evidence = rows.select(
        F.lit(at).alias("execution_datetime"), F.lit(7).cast("long").alias("rule_id"), F.to_json(F.struct("*")).alias("row_json")
    )
    where = scratch(spark, "evidence")
    stores.append(evidence, where, "batch-1", partition_by=("rule_id",))
    mine = stores.evidence_of_run(stores.read(spark, where), 7, at)
    wide = stores.widen_evidence(mine, "l_orderkey long, l_partkey long").select("l_orderkey", "l_partkey")
    return stores.search_evidence(wide, "17", "l_partkey", shown=None)


@registered(
    " UNION ALL ".join(
        f"SELECT '{name}' AS source, count(*) AS row_count, least(count(*), 100) AS preview_rows FROM {name}"
        for name in ("customer", "orders", "lineitem", "documents", "region")
    )
)
def source_preview(spark: SparkSession, path: str) -> DataFrame:
    frames = []
    for name in ("customer", "orders", "lineitem", "documents", "region"):
        rows, count = catalog.preview(table(spark, path, name))
        shown = rows.agg(F.count(F.lit(1)).alias("n"))
        both = count.select("row_count", F.lit(0).cast("long").alias("preview_rows")).unionByName(
            shown.select(F.lit(0).cast("long").alias("row_count"), F.col("n").alias("preview_rows"))
        )
        frames.append(both.agg(F.sum("row_count").alias("row_count"), F.sum("preview_rows").alias("preview_rows")).withColumn("source", F.lit(name)))
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out
