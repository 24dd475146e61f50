"""Small driver-made tables (rule settings, one row per rule or column), as local relations rather than RDDs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_frame(spark: SparkSession, rows: Iterable[Sequence[Any]], ddl: str) -> DataFrame:
    schema = T.StructType.fromDDL(ddl)
    dicts = [dict(zip(schema.names, row, strict=True)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(dicts, schema=to_arrow_schema(schema)), schema=schema)
