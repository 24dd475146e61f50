"""Continuous checks: a rule set on every micro-batch of a stream, with run and evidence rows appended."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans.runner import run_rules
from plumbline.sources.stores import append
from plumbline.spec import Connection, Rule


def start_checks(
    stream: DataFrame,
    rules: Sequence[Rule],
    connections: Mapping[int, Connection],
    *,
    name: str,
    runs_path: str,
    evidence_path: str,
    checkpoint: str,
    available_now: bool = False,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Start the checks. Rules see the micro-batch as their source; reference targets come from ``connections``.

    Results of a batch go to the folder ``<name>-<batch id>``, which a retry of that batch overwrites, so each
    batch is recorded exactly once.
    """

    def check(batch: DataFrame, batch_id: int) -> None:
        label = f"{name}-{batch_id:012d}"
        batch.persist()  # read by the summary and by the evidence
        try:
            result = run_rules(batch.sparkSession, rules, connections, executed_by=name, source=batch)
            append(result.evidence, evidence_path, label)
            append(result.runs, runs_path, label)
        finally:
            batch.unpersist()

    writer = stream.writeStream.queryName(name).foreachBatch(check).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
