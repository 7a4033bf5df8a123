"""Tables that grow by batch folders: each batch writes the rows of the keys it touched under its own number.

A batch that runs again replaces its folder, so sinks are idempotent. The current rows of a key are those of the newest
folder that holds it; `batch` is a partition column, so one scan reads all folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

NUMBER = "batch"


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a job has written the folder to its end."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def append_batch(df: DataFrame, root: str, number: int) -> None:
    """The changed rows of a batch: for every key it touches, all rows the key has from now on."""
    df.write.mode("overwrite").parquet(f"{root}/{NUMBER}={number}")


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """All rows of all batches with their number; none where nothing has been written."""
    schema = f"{schema}, {NUMBER} LONG"
    try:
        return spark.read.schema(schema).parquet(root)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_current(spark: SparkSession, root: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The rows of the newest batch of each key.

    Keys are reduced in every task before the shuffle; the semi join is then on a key that occurs once.
    """
    rows = read_batches(spark, root, schema)
    newest = rows.groupBy(*keys).agg(F.max(NUMBER).alias(NUMBER))
    return rows.join(newest, [*keys, NUMBER], "left_semi").drop(NUMBER)
