"""Even work for small inputs, and names for values used more than once."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

SMALL_BYTES = 256 * 1024 * 1024
# Estimated bytes, compressed as they are stored, of a small input's rows in one task.
SPREAD_BYTES = 4 * 1024 * 1024
# Estimated bytes of rows that one task sorts by a key.
TASK_BYTES = 16 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread_small(df: DataFrame, limit: int = SMALL_BYTES) -> DataFrame:
    """Spread a small input over all cores before work that is heavy per row.

    A small file is often one row group, hence one task. The size is the optimizer's estimate; above
    the limit a table has row groups enough and keeps its scan partitions, without a shuffle. No task gets more than
    `SPREAD_BYTES` by that estimate, so that what it sorts after a join stays small.
    """
    size = estimated_bytes(df)
    if size > limit:
        return df
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // SPREAD_BYTES)))


def deal(df: DataFrame, keys: Sequence[str], task_bytes: int = TASK_BYTES) -> DataFrame:
    """Rows in hash partitions by `keys`: as many as the session's, more where the size estimate asks for it.

    Adaptive execution leaves their number. It would glue partitions by compressed bytes, of which keys have few, until one
    task sorts millions of rows.
    """
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-estimated_bytes(df) // task_bytes))
    return df.repartition(n, *keys)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
