"""Rules written as SQL. The query text goes to Spark unchanged; sources appear to it as temporary views."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.predicates import number_setting

DATASET_VIEW = "dataset_view"
# Accepted spellings of the comparison.
COMPARISONS = {">": ">", ">=": ">=", "<": "<", "<=": "<=", "==": "=", "=": "=", "!=": "<>", "<>": "<>"}


@contextmanager
def views(spark: SparkSession, frames: Mapping[str, DataFrame]) -> Iterator[None]:
    """Give frames names while a query is analysed; views of the session with those names come back afterwards."""
    hidden = {name: spark.table(name) for name in frames if _is_temp_view(spark, name)}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    try:
        yield
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
        for name, frame in hidden.items():
            frame.createOrReplaceTempView(name)


def _is_temp_view(spark: SparkSession, name: str) -> bool:
    return any(table.name == name.lower() and table.isTemporary for table in spark.catalog.listTables(pattern=name.lower()))


def query(spark: SparkSession, sql: str, frames: Mapping[str, DataFrame]) -> DataFrame:
    with views(spark, frames):
        return spark.sql(sql.strip().rstrip(";"))


def fail_rows(spark: SparkSession, config: Mapping[str, Any], source: DataFrame) -> DataFrame:
    """Every row the query returns is a failing row."""
    return query(spark, str(config["sql"]), {DATASET_VIEW: source})


def threshold_rows(spark: SparkSession, config: Mapping[str, Any], source: DataFrame) -> DataFrame:
    """Rows whose ``value`` satisfies the comparison with the threshold."""
    comparison = COMPARISONS.get(str(config.get("operator", ">")))
    if comparison is None:
        raise ValueError("The operator setting must be one of: >, >=, <, <=, ==, !=.")
    threshold = F.lit(number_setting(config["threshold"], "threshold"))
    value = F.col("value")
    tests = {
        ">": value > threshold, ">=": value >= threshold, "<": value < threshold,
        "<=": value <= threshold, "=": value == threshold, "<>": value != threshold,
    }
    return query(spark, str(config["sql"]), {DATASET_VIEW: source}).filter(tests[comparison])


def connection_rows(spark: SparkSession, config: Mapping[str, Any], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Failing rows from a query over every table of a connection."""
    return query(spark, str(config["sql"]), tables)
