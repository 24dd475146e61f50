"""The profile report: five tables without any source row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.frames import small_frame
from plumbline.operators.profile import Profile


def report_tables(label: str, profile: Profile, findings: DataFrame) -> dict[str, DataFrame]:
    """Summary, drift findings, column profile, value frequencies and privacy review, each in display order."""
    columns = profile.columns_frame()
    counts = findings.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("severity") == "high").alias("high")).first()
    metrics = [
        ("Source", label),
        ("Profiled at (UTC)", profile.profiled_at.isoformat()),
        ("Rows", str(profile.row_count)),
        ("Columns profiled", str(len(profile.columns))),
        ("Drift findings", str(counts.n)),
        ("High-severity findings", str(counts.high)),
        ("GDPR review flags", str(len(profile.privacy))),
    ]
    return {
        "summary": small_frame(profile.spark, [(i, *m) for i, m in enumerate(metrics)], "seq int, metric string, value string"),
        "findings": findings.select(
            F.upper("severity").alias("severity"), F.coalesce("column", F.lit("-")).alias("column"), F.col("message").alias("finding")
        ),
        "columns": columns.orderBy("position").select(
            F.col("column").alias("field"),
            "type",
            F.col("inferred_type").alias("meaning"),
            "null_rate",
            "blank_rate",
            F.col("distinct_count").alias("distinct"),
            "min",
            "max",
            "mean",
        ),
        "frequencies": columns.select("position", F.col("column").alias("field"), F.inline("frequency"))
        .orderBy("position", F.desc("count"), "value")
        .drop("position"),
        "privacy": profile.privacy_frame()
        .orderBy("seq")
        .select(F.upper("severity").alias("severity"), "column", "category", "reason"),
    }


def write_report(tables: dict[str, DataFrame], path: str, format: str = "csv") -> None:
    """One folder per table. The tables are small, so each becomes one file."""
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").option("header", "true").format(format).save(f"{path.rstrip('/')}/{name}")
