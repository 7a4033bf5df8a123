"""Spark session settings for local runs and clusters."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Runtime settings the jobs rely on. forceOptimizeSkewedJoin lets AQE split a hot join key even
# when the split costs one more shuffle. The advisory size is of compressed bytes, which sorts and maps of narrow rows
# hold 25 times over in memory, as do joins of what is scanned. Long texts and pages go to Python by bytes: thousands of them would be gigabytes there.
# The excluded rule would evaluate an exploded array twice, once to drop empty ones: here arrays come
# from regular expressions and parsers, and the second pass costs more than it saves.
RUNTIME_CONF = {
    "spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.InferFiltersFromGenerate",
    # A name that a JSON object repeats takes its last value, instead of losing the object or the job.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.files.maxPartitionBytes": "32m",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
    "spark.sql.session.timeZone": "UTC",
}

_PARTITIONS = "spark.sql.shuffle.partitions"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else built, and ship the package."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) is None:  # what the session's owner has set stays
            spark.conf.set(key, value)
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get(_PARTITIONS) == "200":
        # The default is meant for a cluster; streams would keep 200 state stores on one machine.
        spark.conf.set(_PARTITIONS, str(context.defaultParallelism))
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Hand this package to the executors, once per application."""
    context = spark.sparkContext
    if any(name.endswith(".zip") and "dishlens" in name for name in context.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "dishlens.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)


def local_session(cores: int | str = 8, memory: str = "8g", app: str = "dishlens") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.legacy.parquet.nanosAsLong", "false")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach: spark.checkpoint.dir, or a temporary one where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix="spark-")
