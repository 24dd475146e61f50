"""The registered queries: each builds a DataFrame over a folder of Parquet tables, with the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from plumbline.spec import Connection, Rule, RuleType

Build = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}

AS_OF = datetime(2024, 2, 1, tzinfo=timezone.utc)
FOLDER = 1


def registered(oracle: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return add


def folder(path: str) -> dict[int, Connection]:
    return {FOLDER: Connection(FOLDER, "tables", "parquet", {"base_path": path})}


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def source(text: str, side: str = "source") -> dict[str, Any]:
    """Source settings: a table name, or SQL over the tables of the folder."""
    kind = {"sql": text} if " " in text else {"name": f"{text}.parquet"}
    settings = {"connection_id": FOLDER, "kind": "sql" if "sql" in kind else "table", **kind}
    return {f"{side}_{key}": value for key, value in settings.items()}


def rule(id: int, kind: str, from_source: str, **config: Any) -> Rule:
    target = config.pop("target", None)
    settings = {**source(from_source), **(source(target, "target") if target else {}), **config}
    return Rule(id, f"{kind} {id}", RuleType(kind), settings)
