"""Stored results: failing-row evidence, run history and profile snapshots, as append-only Parquet.

Each append goes to its own ``batch`` folder and replaces that folder if it is written again, so a retried batch
leaves no duplicates. Readers prune on the partition columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.scalar import quoted

SNAPSHOTS_KEPT_IN_VIEW = 50
BATCH = "batch"


def append(df: DataFrame, path: str, batch: str, *, partition_by: tuple[str, ...] = ()) -> None:
    """Add one batch of rows; writing the same batch again replaces it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path.rstrip('/')}/{BATCH}={batch}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All batches. The batch name is text even when it looks like a number."""
    return spark.read.option("mergeSchema", "true").parquet(path).withColumn(BATCH, F.col(BATCH).cast("string"))


def evidence_of_run(evidence: DataFrame, rule_id: int, executed_at: object) -> DataFrame:
    when = F.lit(executed_at).cast("timestamp")
    return evidence.filter((F.col("rule_id") == rule_id) & (F.col("execution_datetime") == when))


def search_evidence(rows: DataFrame, text: str, column: str | None = None, shown: int | None = None) -> DataFrame:
    """Rows containing ``text`` in one column or in any, ignoring case; all rows for empty text.

    ``rows`` is the wide form. All rows are searched; ``shown`` limits what comes back.
    """
    needle = text.strip().lower()
    if needle:
        values = F.array(*(F.coalesce(F.col(quoted(name)).cast("string"), F.lit("")) for name in ([column] if column else rows.columns)))
        rows = rows.filter(F.exists(values, lambda value: F.contains(F.lower(value), F.lit(needle))))
    return rows if shown is None else rows.limit(shown)


def widen_evidence(evidence: DataFrame, schema: str) -> DataFrame:
    """Stored JSON rows as columns again; a column a row lacks is NULL."""
    return evidence.withColumn("row", F.from_json("row_json", schema)).select("execution_datetime", "rule_id", "row.*")


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    """The newest runs by id."""
    return runs.orderBy(F.desc("id")).limit(limit)


def latest_snapshots(snapshots: DataFrame, per_source: int = 1) -> DataFrame:
    """The newest snapshots of every source. Spark keeps only that many rows per source before shuffling."""
    newest = Window.partitionBy("source_key").orderBy(F.desc("profiled_at"))
    return snapshots.withColumn("__age", F.row_number().over(newest)).filter(F.col("__age") <= per_source).drop("__age")


def snapshot_series(snapshots: DataFrame, source_key: str, limit: int = SNAPSHOTS_KEPT_IN_VIEW) -> DataFrame:
    """The last snapshots of one source, oldest first."""
    newest = snapshots.filter(F.col("source_key") == source_key).orderBy(F.desc("profiled_at")).limit(limit)
    return newest.orderBy("profiled_at")
