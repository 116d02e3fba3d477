"""Results and nested columns as JSON at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.StructType, T.MapType)


def nested_as_json(rows: DataFrame) -> DataFrame:
    """rows with every array, struct and map as JSON text (null fields kept); null stays null."""
    return rows.select(*(F.to_json(f.name, {"ignoreNullFields": "false"}).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name) for f in rows.schema))


def nested_from_json(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """The reverse of nested_as_json(); text that doesn't fit the schema is an error."""
    return rows.select(*(F.from_json(f.name, f.dataType, {"mode": "FAILFAST"}).alias(f.name) if isinstance(f.dataType, _NESTED) else F.col(f.name) for f in schema))


def write_report(rows: DataFrame, path: str, passed: Column | None = None) -> bool:
    """rows as JSON lines under path (which must not exist); whether all rows passed (true without a condition)."""
    rows.write.json(path)
    return passed is None or not rows.filter(~F.coalesce(passed, F.lit(False))).limit(1).count()
