"""Sinks and merges that write for real and are read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens import schemas
from dishlens.functions import keys
from dishlens.operators.snapshots import read_current
from dishlens.plans import indexing as I, regulatory as G
from dishlens.sources import events as E
from dishlens.streaming import jobs as J
from dishlens.suite.base import ORACLES, query, table
from dishlens.suite.menus import _events, _suppliers
from dishlens.suite.pages import uuid_sql
from dishlens.suite.streams import _run_folder


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS camis, c_name AS dba, CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_custkey % 3 = 1 THEN 1 ELSE 2 END AS urls
FROM customer
""")
def discovery_events_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """NULL lists of urls come back empty; a batch written twice is there once."""
    path = f"{_run_folder(spark)}/discovery"
    url = F.concat(F.lit("https://d/"), "c_custkey")
    urls = F.when(F.col("c_custkey") % 3 == 1, F.array(url)).when(F.col("c_custkey") % 3 == 2, F.array(url, F.lit("https://e/")))
    empty = {c: F.lit("") for c in ("prompt", "response_text", "model", "event_id", "job_id", "created_at")}
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("camis"), F.col("c_name").alias("dba"), urls.alias("source_urls")
    ).withColumns({**empty, "attempt": F.lit(1)})
    for _ in range(2):
        E.write_discovery_events(rows, path, batch=0)
    found = E.read_events(spark, path, schemas.DISCOVERY)
    return found.select("camis", "dba", F.size("source_urls").alias("urls"))


@query("""
WITH batch AS (SELECT l_suppkey AS vector_id, arg_max(l_comment_key, l_comment_key) AS version FROM (
  SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS l_comment_key FROM lineitem) GROUP BY 1)
SELECT s_suppkey AS vector_id, COALESCE(version, -1) AS version, CASE WHEN version IS NULL THEN 'old' ELSE 'new' END AS text
FROM supplier LEFT JOIN batch ON s_suppkey = vector_id
UNION ALL SELECT vector_id, version, 'new' FROM batch WHERE vector_id NOT IN (SELECT s_suppkey FROM supplier)
""")
def regulatory_vector_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The newest version of a vector overwrites all its columns; merged twice."""
    base = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("vector_id"), F.lit(-1).cast("long").alias("version"), F.lit("old").alias("text")
    )
    batch = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("vector_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("version"), F.lit("new").alias("text")
    )
    once = G.upsert_vectors(base, batch, "version")
    return G.upsert_vectors(once, batch, "version").select("vector_id", "version", "text")


@query(f"""
WITH known AS (SELECT DISTINCT p_brand, p_type FROM part WHERE p_brand LIKE '%1'),
proposed AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT {uuid_sql(keys.NS_URL, "p_brand || p_type")} AS id, p_brand AS domain, p_type AS selector, 'proposed' AS status,
  CASE WHEN p_brand LIKE '%1' THEN 't0' END AS activated_at, 't1' AS proposed_at
FROM proposed
""")
def proposed_rule_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rules proposed again keep domain and activation time; a blank status means proposed."""
    rules = table(spark, sf, "part").select(F.col("p_brand").alias("domain"), F.col("p_type").alias("selector"), F.lit("").alias("status"))
    known = rules.filter("domain LIKE '%1'").distinct()
    base = known.select(
        keys.rule_key(F.col("domain"), F.col("selector")).alias("id"), "domain", "selector", F.lit("rejected").alias("status"),
        F.lit("t0").alias("activated_at"), F.lit("t0").alias("proposed_at"),
    )
    once = G.upsert_proposed_rules(base, rules, F.lit("t1"))
    return G.upsert_proposed_rules(once, rules, F.lit("t1")).select("id", "domain", "selector", "status", "activated_at", "proposed_at")


@query("SELECT DISTINCT * FROM (" + ORACLES["replay_menus"] + ")")
def replay_sink_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Menu events in three batches, the last one twice, to the item table: one row per item id."""
    root = _run_folder(spark)
    events = E.with_business_key(_events(spark, sf)).withColumn("created_at", F.lit("2024-01-01T00:00:00Z"))
    sink = J.replay_sink(f"{root}/items", f"{root}/rejects", _suppliers(spark, sf), I.hashing_embedder(64), 64)
    for number in (0, 1, 2, 2):
        sink(events.filter(F.col("l_orderkey") % 3 == number), number)
    schema = "menu_item_id STRING, dish_name STRING, embedding ARRAY<FLOAT>"
    items = read_current(spark, f"{root}/items", schema, ["menu_item_id"])
    return items.select("menu_item_id", "dish_name", F.size("embedding").alias("dim"))
