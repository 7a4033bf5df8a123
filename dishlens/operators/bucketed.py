"""Keyed tables in buckets: a merge shuffles the batch, never the base.

A table is written in a fixed number of buckets by its key. A join on the key then finds the base already dealt out as
it needs it, so only the batch is exchanged, and the merged rows leave the join in the same buckets, ready to be written.
A merge writes the other of a pair of tables, `<name>_0` and `<name>_1`, and the caller goes on with the name it
returns; a job that dies half-way has left the table it read as it was.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int = BUCKETS, dealt: bool = False) -> str:
    """Write the first table of a pair and return its name. `dealt`: the rows already lie in these buckets."""
    rows = df if dealt else df.repartition(buckets, *keys)
    rows.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(f"{name}_0")
    return f"{name}_0"


def bucket_count(spark: SparkSession, table: str) -> int:
    rows = spark.sql(f"DESCRIBE EXTENDED {table}").filter("col_name = 'Num Buckets'").select("data_type").first()
    if rows is None:
        raise ValueError(f"{table} has no buckets")
    return int(rows[0])


def merge_bucketed(
    spark: SparkSession, table: str, batch: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
) -> str:
    """Merge a batch into one table of a pair by `merge(base, batch)`, a join on the keys; returns the other's name."""
    buckets = bucket_count(spark, table)
    other = table[:-1] + ("1" if table.endswith("_0") else "0")
    merged = merged_rows(spark, table, batch, keys, merge, buckets)
    merged.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet").saveAsTable(other)
    return other


def merged_rows(
    spark: SparkSession, table: str, batch: DataFrame, keys: Sequence[str], merge: Callable[[DataFrame, DataFrame], DataFrame],
    buckets: int,
) -> DataFrame:
    """The merged rows before they are written; the batch is dealt into the table's buckets by the keys' own types."""
    base = spark.table(table)
    kinds = {f.name: f.dataType for f in base.schema.fields}
    cast = batch.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})
    return merge(base, cast.repartition(buckets, *keys))
