"""Incremental jobs on Structured Streaming.

Sinks run in foreachBatch and are idempotent per batch number, so a batch that is run again after a
lost executor or driver leaves the same state. Checkpoints and tables live in folders the caller
names; on a cluster those must be shared.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dishlens import schemas
from dishlens.operators.snapshots import NUMBER, append_batch, read_batches, read_current
from dishlens.operators.merge import last_of_batch
from dishlens.plans.indexing import EmbedFn, index_batch
from dishlens.plans.menus import replay_last

log = logging.getLogger(__name__)

CHUNK_SCHEMA = schemas.CHUNK + ", norm DOUBLE"
CHUNK_COLUMNS = ["chunk_id", "review_id", "chunk_ix", "chunk_text", "embedding", "norm"]


def file_stream(
    spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_available(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Work off what is there and stop; the next run goes on from the checkpoint."""
    return (
        stream.writeStream.outputMode(mode).foreachBatch(sink)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


# ---------------------------------------------------------------- index and replay

def index_sink(root: str, embed: EmbedFn) -> Callable[[DataFrame, int], None]:
    """Chunk and embed each batch of joined reviews and append it to the chunk table under `root`.

    All chunks of a review in the batch replace those it had, so a shorter text leaves none behind. Each
    review of the batch also leaves a mark, a row without a chunk id: a text that has become NULL or
    empty hides its older chunks by it.
    """

    def sink(batch: DataFrame, number: int) -> None:
        fresh = index_batch(last_of_batch(batch, ["review_id"], []), embed).select(*CHUNK_COLUMNS)
        marks = batch.select("review_id").distinct().select(*[
            F.col(c) if c == "review_id" else F.lit(None).cast(fresh.schema[c].dataType).alias(c)
            for c in CHUNK_COLUMNS
        ])
        append_batch(fresh.unionByName(marks), root, number)

    return sink


def current_chunks(spark: SparkSession, root: str) -> DataFrame:
    return read_current(spark, root, CHUNK_SCHEMA, ["review_id"]).filter("chunk_id IS NOT NULL")


def replay_sink(
    root: str, rejects: str, restaurants: DataFrame, embed: EmbedFn, dim: int
) -> Callable[[DataFrame, int], None]:
    """Menu extraction events to the item table, as the batch replay does it; what it rejects goes to
    the dead letters, one folder per batch."""

    def sink(batch: DataFrame, number: int) -> None:
        items, bad = replay_last(batch, restaurants, embed, dim, f"{rejects}-texts/{NUMBER}={number}")
        append_batch(items, root, number)
        append_batch(bad, rejects, number)

    return sink


def dual_sink(
    primary: Callable[[DataFrame, int], None], mirror: Callable[[DataFrame, int], None], root: str
) -> Callable[[DataFrame, int], None]:
    """The primary write must succeed; what a failing mirror didn't take waits in an outbox below `root`.

    Waiting batches are delivered again, the oldest first, before the newest one is sent, so the mirror sees all batches in
    their order. A batch is recorded only when it fails; if the job dies before, the stream runs it again.
    """
    known: dict[str, set[int]] = {}

    def note(spark: SparkSession, number: int, tried: bool, error: str | None) -> None:
        row = spark.createDataFrame([(number, tried, error)], ATTEMPT)
        row.coalesce(1).write.mode("append").parquet(f"{root}/attempts")
        known["noted"].add(number)

    def send(rows: DataFrame, number: int) -> bool:
        try:
            mirror(rows, number)
        except Exception as problem:
            log.exception("mirror write of batch %s failed", number)
            note(rows.sparkSession, number, True, f"{type(problem).__name__}: {problem}"[:500])
            return False
        if number in known["noted"]:
            note(rows.sparkSession, number, True, None)
        return True

    def keep(rows: DataFrame, number: int) -> None:
        append_batch(rows, f"{root}/rows", number)
        known["waiting"].add(number)

    def sink(batch: DataFrame, number: int) -> None:
        primary(batch, number)
        spark = batch.sparkSession
        if not known:  # at the start and after a restart
            found = outbox(spark, root).collect()
            known["noted"] = {r["number"] for r in found}
            known["waiting"] = {r["number"] for r in found if not r["delivered"]} - {number}
        for old in sorted(known["waiting"]):
            if not send(spark.read.schema(batch.schema).parquet(f"{root}/rows/batch={old}"), old):
                keep(batch, number)
                note(spark, number, False, f"waits for batch {old}")
                return
            known["waiting"].discard(old)
        if not send(batch, number):
            keep(batch, number)

    return sink


ATTEMPT = "number LONG, tried BOOLEAN, error STRING"


def outbox(spark: SparkSession, root: str) -> DataFrame:
    """(number, attempts, delivered, last_error) of every batch that the mirror didn't take at once."""
    try:
        notes = spark.read.schema(ATTEMPT).parquet(f"{root}/attempts")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        notes = spark.createDataFrame([], ATTEMPT)
    return notes.groupBy("number").agg(
        F.count_if("tried").alias("attempts"), (F.count_if(F.col("tried") & F.col("error").isNull()) > 0).alias("delivered"),
        F.max("error").alias("last_error"),
    )


# ---------------------------------------------------------------- counts and unique jobs

def daily_counts(stream: DataFrame, ts: str) -> DataFrame:
    """Rows per day, in update mode. A day is one row of state, so the state stays small without a watermark, and no row
    comes too late to be counted."""
    return (
        stream.groupBy(F.window(ts, "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
        .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")
    )


def batch_folder_sink(root: str) -> Callable[[DataFrame, int], None]:
    """Each batch's changed rows in a folder of its own number."""

    def sink(batch: DataFrame, number: int) -> None:
        append_batch(batch, root, number)

    return sink


def latest_values(spark: SparkSession, root: str, key: str, schema: str) -> DataFrame:
    """Newest row per key over the batch folders of an update-mode stream."""
    rows = read_batches(spark, root, schema)
    value = F.struct("batch", *[c for c in rows.columns if c not in (key, "batch")])
    newest = rows.groupBy(key).agg(F.max(value).alias("v"))
    return newest.select(key, "v.*").drop("batch")


# ---------------------------------------------------------------- incremental import

def since_high_water(source: DataFrame, base: DataFrame, record: str, updated: Column) -> DataFrame:
    """Source records changed after the newest change of the base table."""
    newest = base.agg(F.max(updated).alias("newest")).first()["newest"]
    return source if newest is None else source.filter(F.col(record) > F.lit(newest))
