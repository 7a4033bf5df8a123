"""Incremental jobs run to the end over the event table, against their batch answers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.plans import indexing as I
from dishlens.session import shared_folder
from dishlens.streaming import counts as N, jobs as J, state as S
from dishlens.suite.base import ORACLES, derive, query, table
from dishlens.suite.restaurants import _FOLD_BASE, SCRAPE_EVENT


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return J.file_stream(spark, f"{sf}/{name}.parquet*", schema)


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def stream_daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = J.daily_counts(events, "ts")
    J.run_available(counts, J.batch_folder_sink(f"{folder}/out"), f"{folder}/log", "update").awaitTermination()
    return J.latest_values(spark, f"{folder}/out", "day", "day STRING, n LONG")


_PERIOD = 2_592_000  # 30 days


@query(f"""
SELECT user_id, event_type, CAST(epoch_ms(ts) // {_PERIOD * 1000} AS BIGINT) AS period, CAST(0 AS BIGINT) AS batch, 'job' AS kind
FROM events GROUP BY ALL
""")
def stream_unique_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """What the state store gave out, late rows included: there are none in one batch."""
    folder = _run_folder(spark)
    events = _stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    unique = S.unique_jobs(events, ["user_id", "event_type"], "ts", _PERIOD)
    J.run_available(unique, J.batch_folder_sink(f"{folder}/out"), f"{folder}/log").awaitTermination()
    return spark.read.schema("user_id LONG, event_type STRING, period LONG, kind STRING, batch LONG").parquet(f"{folder}/out")


@query(ORACLES["scrape_state_fold"])
def stream_scrape_fold(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    users = table(spark, sf, "events").filter("event_type <> 'signup'").select("user_id").distinct()
    base = derive(users, {**_FOLD_BASE, "scraped_at": "CAST(NULL AS TIMESTAMP_NTZ)"})
    changed = S.scrape_states(derive(_stream(spark, sf, "events"), SCRAPE_EVENT), base)
    J.run_available(changed, J.batch_folder_sink(f"{folder}/out"), f"{folder}/log", "update").awaitTermination()
    rows = spark.read.schema(changed.schema.add("batch", "long")).parquet(f"{folder}/out")
    return S.with_states(base, rows)


@query(f"""
SELECT status, count(*) AS n, CAST(coalesce(sum(item_count), 0) AS BIGINT) AS items
FROM ({ORACLES["scrape_state_fold"]}) GROUP BY status
""")
def stream_status_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the base brought up to date by the differences that the stream left; no restaurant is read again."""
    folder = _run_folder(spark)
    users = table(spark, sf, "events").filter("event_type <> 'signup'").select("user_id").distinct()
    base = derive(users, {**_FOLD_BASE, "scraped_at": "CAST(NULL AS TIMESTAMP_NTZ)"})
    changed = S.scrape_states(derive(_stream(spark, sf, "events"), SCRAPE_EVENT), base)
    sink = N.differences_sink(f"{folder}/counts", N.status_differences)
    J.run_available(changed, sink, f"{folder}/log", "update").awaitTermination()
    start = N.totals(base, {"status": F.col("status")}, {"n": F.lit(1), "items": F.col("item_count")})
    return N.current(start, f"{folder}/counts", ["status"], ["n", "items"])


@query("SELECT event_id, user_id, event_type, event_id % 4 AS batch FROM events")
def mirror_outbox(spark: SparkSession, sf: str) -> DataFrame:
    """Four batches to a table and a mirror that fails twice: what the mirror holds in the end."""
    folder, down = _run_folder(spark), {1: 2}

    def mirror(batch: DataFrame, number: int) -> None:
        if down.get(number):
            down[number] -= 1
            raise OSError("mirror down")
        J.batch_folder_sink(f"{folder}/mirror")(batch, number)

    sink = J.dual_sink(J.batch_folder_sink(f"{folder}/table"), mirror, f"{folder}/outbox")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for number in range(4):
        sink(events.filter(F.col("event_id") % 4 == number), number)
    return spark.read.schema("event_id LONG, user_id LONG, event_type STRING, batch LONG").parquet(f"{folder}/mirror")


@query()
def stream_index(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark)
    reviews = _stream(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("review_id"), "text")
    sink = J.index_sink(f"{folder}/chunks", I.hashing_embedder(32))
    J.run_available(reviews, sink, f"{folder}/log").awaitTermination()
    return J.current_chunks(spark, f"{folder}/chunks").drop("embedding")
