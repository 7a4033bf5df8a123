"""Registry of runnable queries over the driver tables, each with the SQL that must agree."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table. Its schema is read from the file once per process."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Input table derived from a driver table by column expressions both engines read."""
    return df.selectExpr(*[f"{to_spark(e)} AS {n}" for n, e in columns.items()])


def derive_sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{to_duck(e)} AS {n}" for n, e in columns.items()) + f" FROM {source}"


def to_spark(expression: str) -> str:
    return expression.replace("LIST(", "array(").replace("\\", "\\\\")


def to_duck(expression: str) -> str:
    expression = expression.replace("LIST(", "list_value(")
    return re.sub(r"\bSTRING\b", "VARCHAR", expression)
