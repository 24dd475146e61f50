"""Registered queries for streams and for CSV sources written from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.examples.registry import AS_OF, FOLDER, folder, registered, rule, table
from plumbline.plans import runner
from plumbline.plans.durable import scratch
from plumbline.sources import catalog, csv, stores
from plumbline.spec import Connection, Rule, RuleType
from plumbline.streaming import keyed
from plumbline.streaming.checks import start_checks
from plumbline.streaming.volume import start_trend, windowed_trend


def event_rules() -> list[Rule]:
    return [
        rule(1, "value_range", "events", column="value", min=1, max=200),
        rule(2, "allowed_values", "events", column="event_type", values=["click", "view", "purchase", "signup"]),
        rule(3, "regex", "events", column="props", pattern=r'^\{"k": [0-9]{2}\}$'),
    ]


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    schema = table(spark, path, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(path)


FAILED_EVENTS = (
    "count(*) FILTER (value < 1 OR value > 200) AS failed_1, count(*) FILTER (event_type = 'error') AS failed_2, "
    "count(*) FILTER (NOT regexp_matches(props, '^\\{\"k\": [0-9]{2}\\}$')) AS failed_3"
)


@registered(
    f"WITH c AS (SELECT count(*) AS n, {FAILED_EVENTS} FROM events) SELECT t.*, least(t.failed_count, 500) AS evidence_rows FROM c, LATERAL (VALUES "
    "(1::BIGINT, n, failed_1), (2, n, failed_2), (3, n, failed_3)) AS t(rule_id, checked_count, failed_count)"
)
def stream_checks(spark: SparkSession, path: str) -> DataFrame:
    """The whole event stream checked batch by batch; recorded runs add up to the table's figures."""
    where = scratch(spark, "stream")
    query = start_checks(
        event_stream(spark, path), event_rules(), {}, name="event-checks", runs_path=f"{where}/runs",
        evidence_path=f"{where}/evidence", checkpoint=f"{where}/state", available_now=True,
    )
    query.awaitTermination()
    runs = stores.read(spark, f"{where}/runs").groupBy("rule_id").agg(
        F.sum("checked_count").alias("checked_count"), F.sum("failed_count").alias("failed_count")
    )
    evidence = stores.read(spark, f"{where}/evidence").groupBy("rule_id").agg(F.count(F.lit(1)).alias("evidence_rows"))
    return runs.join(evidence, "rule_id", "left")


WINDOWS = (
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS window_end, count(*) AS row_count, "
    f"{FAILED_EVENTS}, CASE WHEN count(*) BETWEEN 300 AND 3000 THEN 'passed' ELSE 'failed' END AS status FROM events GROUP BY ALL"
)


def _plain_times(trend: DataFrame) -> DataFrame:
    return trend.withColumns({name: F.col(name).cast("timestamp_ntz") for name in ("window_start", "window_end")})


@registered(WINDOWS)
def window_volume(spark: SparkSession, path: str) -> DataFrame:
    """The trend over the table."""
    trend = windowed_trend(table(spark, path, "events"), "ts", "1 day", event_rules(), min_count=300, max_count=3000)
    return _plain_times(trend)


@registered(f"SELECT * FROM ({WINDOWS}) WHERE window_end <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_window_volume(spark: SparkSession, path: str) -> DataFrame:
    """The same trend over the stream: every window the watermark has closed."""
    trend = windowed_trend(
        event_stream(spark, path), "ts", "1 day", event_rules(), min_count=300, max_count=3000, lateness="1 hour"
    )
    where = scratch(spark, "trend")
    start_trend(trend, f"{where}/windows", f"{where}/state", available_now=True).awaitTermination()
    return _plain_times(spark.read.schema(trend.schema).parquet(f"{where}/windows"))


ARRIVALS = 3


def arriving_events(spark: SparkSession, path: str, where: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """The event table in three arrivals in order of time; after each the query runs on from where it stopped."""
    events = table(spark, path, "events")
    days = F.datediff("ts", F.lit("2024-01-01"))
    for i in range(ARRIVALS):
        arrived = F.least(F.greatest(F.floor(days / 10), F.lit(0)), F.lit(ARRIVALS - 1)) == i
        events.filter(arrived).write.mode("append").parquet(f"{where}/events")
        start(spark.readStream.schema(events.schema).parquet(f"{where}/events")).awaitTermination()


@registered(
    "SELECT user_id, props, count(*) AS failed_count FROM events WHERE user_id IS NOT NULL AND props IS NOT NULL GROUP BY ALL HAVING count(*) > 1"
)
def stream_unique_keys(spark: SparkSession, path: str) -> DataFrame:
    """Keys repeated anywhere in the stream, in one micro-batch or several."""
    where, columns = scratch(spark, "unique"), ["user_id", "props"]
    arriving_events(spark, path, where, lambda stream: keyed.start_unique(
        stream, columns, f"{where}/found", f"{where}/state", name="event-keys", available_now=True))
    return keyed.repeated_keys(spark, f"{where}/found", columns).drop(keyed.WINDOW_START)


@registered(
    "WITH g AS (SELECT user_id, event_type, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOUR, TRUE) AS opens FROM events WHERE user_id IS NOT NULL AND "
    "event_type IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)), r AS (SELECT *, count(*) FILTER (opens) OVER "
    "(PARTITION BY user_id, event_type ORDER BY ts) AS run FROM g) SELECT user_id, event_type, min(ts) AS window_start, count(*) AS failed_count FROM r "
    "GROUP BY user_id, event_type, run HAVING count(*) > 1 AND max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"
)
def stream_unique_horizon(spark: SparkSession, path: str) -> DataFrame:
    """Events of one user and type less than six hours apart: every group the watermark has closed."""
    where, columns = scratch(spark, "unique"), ["user_id", "event_type"]
    arriving_events(spark, path, where, lambda stream: keyed.start_unique(
        stream, columns, f"{where}/found", f"{where}/state", name="event-repeats", time_column="ts", horizon="6 hours", lateness="1 hour",
        available_now=True))
    found = keyed.repeated_keys(spark, f"{where}/found", columns)
    return found.withColumn(keyed.WINDOW_START, F.col(keyed.WINDOW_START).cast("timestamp_ntz"))


@registered(
    "SELECT user_id, count(*) AS failed_count FROM events p WHERE event_type = 'purchase' AND NOT EXISTS (SELECT 1 FROM events s WHERE s.event_type = 'signup' "
    "AND s.user_id = p.user_id AND s.ts <= p.ts + INTERVAL 6 HOUR) AND time_bucket(INTERVAL 6 HOUR, p.ts + INTERVAL 6 HOUR, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR "
    "<= (SELECT least(max(ts) FILTER (event_type = 'purchase'), max(ts) FILTER (event_type = 'signup')) - INTERVAL 1 HOUR FROM events) GROUP BY user_id"
)
def stream_references(spark: SparkSession, path: str) -> DataFrame:
    """Purchases of users who have not signed up by six hours later, over the whole stream, as far as the watermark decides."""
    where = scratch(spark, "references")

    def start(stream: DataFrame) -> StreamingQuery:
        sides = [stream.filter(F.col("event_type") == kind) for kind in ("purchase", "signup")]
        missing = keyed.missing_references(sides[0], "user_id", "ts", sides[1], "user_id", "ts", wait="6 hours", lateness="1 hour")
        return keyed.start_references(missing, f"{where}/found", f"{where}/state", available_now=True)

    arriving_events(spark, path, where, start)
    found = spark.read.schema("key string, due timestamp, failed_count long").parquet(f"{where}/found")
    return found.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.sum("failed_count").alias("failed_count"))


# --- CSV --------------------------------------------------------------------------------------------------------


def write_csv(df: DataFrame, where: str, sep: str = ",", encoding: str = "UTF-8") -> None:
    df.write.option("header", "true").option("sep", sep).option("encoding", encoding).option("quoteAll", "true").option("escape", '"').csv(where)


@registered(
    "SELECT doc_id, text, lang FROM documents UNION ALL SELECT p_partkey, regexp_replace(p_name, 'r', 'é', 'g'), p_brand FROM part"
)
def csv_round_trip(spark: SparkSession, path: str) -> DataFrame:
    """Documents as UTF-8 CSV with line breaks in fields, parts as Latin-1 CSV with semicolons; both detected on reading."""
    where = scratch(spark, "csv")
    write_csv(table(spark, path, "documents").select("doc_id", "text", "lang"), f"{where}/documents")
    parts = table(spark, path, "part").select("p_partkey", F.regexp_replace("p_name", "r", "é").alias("p_name"), "p_brand")
    write_csv(parts, f"{where}/parts", ";", "ISO-8859-1")
    return (
        csv.read_csv(spark, f"{where}/documents")
        .select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
        .union(csv.read_csv(spark, f"{where}/parts").select(F.col("p_partkey").cast("long"), "p_name", "p_brand"))
    )


@registered("SELECT p_partkey, regexp_replace(p_name, 'r', 'é', 'g') AS p_name, p_brand FROM part")
def csv_mixed_folder(spark: SparkSession, path: str) -> DataFrame:
    """One folder whose files differ in delimiter, encoding and order of columns, read as one table."""
    where = scratch(spark, "csv")
    parts = table(spark, path, "part").select("p_partkey", F.regexp_replace("p_name", "r", "é").alias("p_name"), "p_brand")
    kinds = ((",", "UTF-8"), (";", "UTF-8"), ("|", "ISO-8859-1"), ("\t", "UTF-16"))
    for i, (sep, encoding) in enumerate(kinds):
        own = parts.filter(F.col("p_partkey") % len(kinds) == i)
        write_csv(own.select(*(reversed(parts.columns) if i == 1 else parts.columns)), f"{where}/mixed/{i}", sep, encoding)
    return csv.read_csv(spark, f"{where}/mixed").select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", "p_brand")


@registered(
    "SELECT 'latin' AS folder, 'latin-1' AS encoding, FALSE AS multi_line, count(*) AS records FROM part UNION ALL "
    "SELECT 'utf8', 'utf-8', count(*) FILTER (contains(text, chr(10))) > 0, count(*) FROM documents UNION ALL SELECT 'wide', 'utf-16', FALSE, count(*) FROM nation"
)
def csv_encodings(spark: SparkSession, path: str) -> DataFrame:
    """Three folders of files of different encodings: what is found in them, and how many records are read that way."""
    where = scratch(spark, "csv")
    accented = table(spark, path, "part").select("p_partkey", F.concat(F.lit("é"), "p_name").alias("p_name"))
    write_csv(accented, f"{where}/latin", ";", "ISO-8859-1")
    write_csv(table(spark, path, "documents").select("doc_id", "text"), f"{where}/utf8")
    write_csv(table(spark, path, "nation"), f"{where}/wide", ",", "UTF-16")
    folder = F.regexp_extract("path", "/([^/]+)/[^/]+$", 1).alias("folder")
    multi_line = F.bool_or(F.col("multi_line") & (F.col("encoding") != "utf-16"))  # bytes of UTF-16 are not lines
    found = csv.encodings(spark, where).filter(F.col("path").endswith(".csv")).groupBy(folder).agg(F.min("encoding").alias("encoding"), multi_line.alias("multi_line"))
    read = [csv.read_csv(spark, f"{where}/{name}").agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("folder"), "records") for name in ("latin", "utf8", "wide")]
    return found.join(reduce(DataFrame.union, read), "folder")


@registered(
    "SELECT o.o_orderkey, c.c_name FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) c ON o.o_custkey = c.c_custkey "
    "WHERE c.c_custkey IS NULL OR c.c_acctbal > 9000"
)
def csv_joined_source(spark: SparkSession, path: str) -> DataFrame:
    """Two CSV sources under aliases, joined by SQL."""
    where = scratch(spark, "csv")
    write_csv(table(spark, path, "orders").select("o_orderkey", "o_custkey"), f"{where}/orders", "|")
    write_csv(table(spark, path, "customer").filter("c_acctbal >= 0"), f"{where}/customers", "\t")
    joined = catalog.join_source(
        spark,
        {"o": {"path": f"{where}/orders"}, "c": {"path": f"{where}/customers"}},
        "SELECT o.o_orderkey, c.c_name FROM t_o o LEFT JOIN t_c c ON o.o_custkey = c.c_custkey WHERE c.c_custkey IS NULL OR c.c_acctbal > 9000",
    )
    return joined.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "c_name")


@registered(
    "SELECT 1::BIGINT AS rule_id, count(*) AS checked_count, count(*) AS failed_count FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal < 0 "
    "UNION ALL SELECT 2, count(*), count(*) FILTER (c_acctbal < 0) FROM customer UNION ALL "
    "SELECT 3, count(*), count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) FROM orders"
)
def csv_connection_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules on a folder of CSV files: SQL over all of them, one file, and a reference into the Parquet tables."""
    where = scratch(spark, "csv")
    write_csv(table(spark, path, "orders").select("o_orderkey", "o_custkey").repartition(3), f"{where}/orders")
    write_csv(table(spark, path, "customer"), f"{where}/customer")
    connections = {**folder(path), 2: Connection(2, "files", "csv", {"base_path": where})}

    def on_csv(id: int, kind: str, **config: object) -> Rule:
        return Rule(id, kind, RuleType(kind), {"source_connection_id": 2, "source_kind": "csv_file", **config})

    sql = "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal < 0"
    target = {"target_connection_id": FOLDER, "target_kind": "sql", "target_sql": "SELECT c_custkey FROM customer WHERE c_acctbal > 0"}
    rules = [
        on_csv(1, "custom_sql_connection", source_kind="connection", sql=sql),
        on_csv(2, "value_range", source_name="customer", column="c_acctbal", min=0, max=1_000_000),
        on_csv(3, "referential_integrity", source_name="orders", source_key="O_CUSTKEY", target_key="c_custkey", **target),
    ]
    return runner.summarise(spark, rules, connections, AS_OF).select("rule_id", "checked_count", "failed_count")
