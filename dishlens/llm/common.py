"""What the operators of this package share: inputs, written tables, range splits, gapless numbers, word caches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dishlens.session import RUNTIME_CONF, shared_folder, ship

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Hand the package to the executors; texts go to Python by bytes, as 10,000 of them would be tens of MB at a time.

    The session's own settings stay as they are.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, RUNTIME_CONF[_BATCH_BYTES])
    ship(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of a documents table; a null text is the empty text."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one all executors share (spark.checkpoint.dir)."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def id_mod(divisor: int) -> Column:
    """crc32 of the id's decimal text, modulo divisor; ids that are null give null."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


def range_splits(ids: DataFrame, pieces: int) -> list[int]:
    """Sorted distinct ids that start ranges of about equally many rows; at most `pieces` of them.

    The first is the smallest id; an empty table gives none. Only this bounded list reaches the driver.
    """
    pieces = max(1, pieces)
    found = ids.agg(
        F.min("doc_id").alias("low"),
        F.percentile_approx("doc_id", [i / pieces for i in range(pieces)], F.lit(20 * pieces)).alias("cuts"),
    ).first()
    if found is None or found["low"] is None:
        return []
    return sorted({found["low"], *found["cuts"]})


def gapless(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, buckets: int) -> DataFrame:
    """Number the rows of each group from 0 without bringing a group into one task.

    Rows are dealt into hash buckets of `order`; a bucket's first number is the count of the buckets
    before it, so only (group, bucket) has to fit a task. Rows that tie in all of `order` are numbered
    in any order. The input is computed twice, so hand in a scan or a written table.
    """
    keys = [*group, "_bucket"]
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = dealt.groupBy(*keys).agg(F.count("*").alias("_rows")).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
    )
    within = Window.partitionBy(*keys).orderBy(*order)
    ranked = dealt.withColumn("_rank", F.row_number().over(within))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return (
        ranked.join(first, condition)
        .withColumn(name, F.col("_first") + F.col("_rank") - 1)
        .drop("_first", "_rank", "_bucket", *[f"_k_{k}" for k in keys])
    )


class WordCache(dict):
    """What a function says of a word, computed once; cleared when it holds `limit` words."""

    def __init__(self, fill: Callable[[str], object], limit: int = 600_000):
        super().__init__()
        self.fill, self.limit = fill, limit

    def __missing__(self, word: str):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.fill(word)
        return value
