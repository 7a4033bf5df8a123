"""Regulatory tracking over events (JSON properties) and parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.functions import keys
from dishlens.functions.jsonsel import select_json, structured_update
from dishlens.plans import regulatory as G
from dishlens.suite.base import query, table
from dishlens.suite.pages import uuid_sql


@query("""
WITH t AS (
  SELECT event_id, props, CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'json:k' WHEN 2 THEN 'json:absent' WHEN 3 THEN 'css:.x' ELSE 'json:k' END AS selector,
    CASE WHEN event_id % 5 = 4 THEN '[' || props || ']' ELSE props END AS content FROM events)
SELECT event_id, CASE event_id % 5 WHEN 0 THEN content WHEN 1 THEN props->>'$.k' ELSE '' END AS picked FROM t
""")
def json_selector(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").selectExpr(
        "event_id",
        "CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'json:k' WHEN 2 THEN 'json:absent' WHEN 3 THEN 'css:.x' ELSE 'json:k' END AS selector",
        "CASE WHEN event_id % 5 = 4 THEN '[' || props || ']' ELSE props END AS content",
    )
    return rows.select("event_id", select_json("content", "selector").alias("picked"))


# Pages: one per part, its domain is the brand. Rules: one or more per brand.
def _pages(spark: SparkSession, sf: str) -> DataFrame:
    update = F.struct(
        F.col("p_partkey").cast("string").alias("cas_number"),
        F.when(F.col("p_partkey") % 4 == 0, F.lit("")).otherwise(F.col("p_name")).alias("substance_name"),
        F.lit("addition").alias("change_type"), F.col("p_type").alias("description"),
        F.lit("2024-05-01").alias("effective_date"),
    )
    content = F.when(F.col("p_partkey") % 5 == 0, F.lit("<html>")).otherwise(F.to_json(F.struct(update.alias("results"))))
    return table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("domain"), F.concat(F.lit("https://g/"), "p_partkey").alias("url"), content.alias("content")
    )


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = table(spark, sf, "part").select("p_brand", "p_type").distinct()
    selector = F.when(F.col("p_type") < "M", "json:results").otherwise("json:other")
    return rules.select(
        keys.rule_key(F.col("p_brand"), F.col("p_type")).alias("id"), F.col("p_brand").alias("domain"), selector.alias("selector"),
        F.when(F.col("p_brand").endswith("1"), "proposed").when(F.col("p_type") == "PROMO", "rejected").otherwise("active").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("activated_at"),
    )


_RULES = f"""
pages_t AS (
  SELECT p_partkey, p_brand AS domain, p_name, p_partkey % 5 = 0 AS broken, p_partkey % 4 = 0 AS nameless FROM part),
rules AS (
  SELECT {uuid_sql(keys.NS_URL, "p_brand || p_type")} AS id, p_brand AS domain, CASE WHEN p_type < 'M' THEN 'json:results' ELSE 'json:other' END AS selector,
    CASE WHEN p_brand LIKE '%1' THEN 'proposed' WHEN p_type = 'PROMO' THEN 'rejected' ELSE 'active' END AS status
  FROM (SELECT DISTINCT p_brand, p_type FROM part)),
active AS (SELECT domain, min(id) AS rule_id, arg_min(selector, id) AS selector FROM rules WHERE status = 'active' GROUP BY 1)"""


@query(f"""
WITH {_RULES}
SELECT p_partkey, rule_id, CASE WHEN rule_id IS NOT NULL AND selector = 'json:results' AND NOT broken AND NOT nameless THEN p_name END AS substance
FROM pages_t LEFT JOIN active USING (domain)
""")
def rule_fast_path(spark: SparkSession, sf: str) -> DataFrame:
    applied = G.apply_rules(_pages(spark, sf), _rules(spark, sf))
    return applied.select("p_partkey", "rule_id", F.col("update.substance_name").alias("substance"))


@query(f"""
WITH {_RULES},
checks AS (SELECT r.id, bool_and(r.selector = 'json:results' AND NOT broken AND NOT nameless) AS good
  FROM rules r JOIN (SELECT domain, arg_max(broken, p_partkey) AS broken, arg_max(nameless, p_partkey) AS nameless FROM pages_t GROUP BY 1) p
    ON p.domain = r.domain WHERE status = 'proposed' GROUP BY 1)
SELECT r.id, CASE WHEN c.id IS NULL THEN r.status WHEN good THEN 'active' ELSE 'rejected' END AS status, COALESCE(good, FALSE) AS activated
FROM rules r LEFT JOIN checks c ON c.id = r.id
""")
def rule_verify(spark: SparkSession, sf: str) -> DataFrame:
    rules = _rules(spark, sf)
    samples = _pages(spark, sf).groupBy("domain").agg(F.max_by("content", "p_partkey").alias("content"))
    checks = rules.select(F.col("id").alias("rule_id"), "domain").join(samples, "domain").select("rule_id", "content")
    as_of = F.expr("TIMESTAMP_NTZ '2024-06-01 00:00:00'")
    settled = G.settle_rules(rules, G.verify_rules(rules, checks), as_of)
    return settled.select("id", "status", F.col("activated_at").isNotNull().alias("activated"))


_UPDATE_ID = uuid_sql(keys.NS_URL, "p_brand || '2024-06-01' || p_size || p_name")


@query(f"""
WITH b AS (SELECT {_UPDATE_ID} AS id, p_partkey, p_brand, p_name, p_type, p_size FROM part),
base AS (SELECT id, 'old ' || min(p_brand) AS source_id, 'old' AS description, 'c' || min(p_size) AS cas FROM b WHERE p_type = 'PROMO' GROUP BY id),
batch AS (SELECT id, arg_max(p_brand, p_partkey) AS source_id, arg_max(p_type, p_partkey) AS description, CAST(arg_max(p_size, p_partkey) AS VARCHAR) AS cas FROM b WHERE p_type <> 'ECONOMY' GROUP BY id)
SELECT COALESCE(x.id, y.id) AS id, COALESCE(x.source_id, y.source_id) AS source_id, COALESCE(y.description, x.description) AS description, COALESCE(x.cas, y.cas) AS cas_number
FROM base x FULL JOIN batch y ON x.id = y.id
""")
def regulatory_upsert(spark: SparkSession, sf: str) -> DataFrame:
    as_of = F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'")
    rows = table(spark, sf, "part").select(
        "p_partkey", "p_type", "p_size", F.col("p_brand").alias("source_id"), F.col("p_size").cast("string").alias("cas_number"),
        F.col("p_name").alias("substance_name"), F.col("p_type").alias("description"), F.lit("raw").alias("raw_path"),
    )
    keyed = G.with_update_keys(rows, as_of)
    base = keyed.filter("p_type = 'PROMO'").groupBy("id").agg(
        F.concat(F.lit("old "), F.min("source_id")).alias("source_id"), F.lit("old").alias("description"),
        F.concat(F.lit("c"), F.min("p_size")).alias("cas_number"), F.lit("kept").alias("raw_path"),
    )
    batch = keyed.filter("p_type <> 'ECONOMY'")
    return G.upsert_updates(base, batch, "p_partkey").drop("raw_path")


@query(f"""
SELECT p_partkey, {_UPDATE_ID} AS id,
  {uuid_sql(keys.NS_REGULATORY, uuid_sql(keys.NS_URL, "p_brand || p_size || p_name"))} AS vector_id, 'search_document: ' || p_name AS body FROM part
""")
def regulatory_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(
        "p_partkey", F.col("p_brand").alias("source_id"), F.col("p_size").cast("string").alias("cas_number"), F.col("p_name").alias("substance_name")
    )
    keyed = G.with_update_keys(rows, F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'"))
    return keyed.select("p_partkey", "id", "vector_id", G.vector_text(F.col("substance_name")).alias("body"))


@query(f"""
WITH b AS (SELECT DISTINCT p_brand AS domain FROM part)
SELECT {uuid_sql(keys.NS_URL, "domain")} AS id, domain, CASE WHEN domain LIKE '%2%' THEN 'new ' || domain ELSE 'old' END AS name,
  CASE WHEN domain LIKE '%1%' THEN 2023 ELSE 2024 END AS created FROM b WHERE domain LIKE '%1%' OR domain LIKE '%2%' ORDER BY domain
""")
def source_upsert(spark: SparkSession, sf: str) -> DataFrame:
    domains = table(spark, sf, "part").select(F.col("p_brand").alias("domain")).distinct()

    def shape(df: DataFrame, name, year: int) -> DataFrame:
        stamp = F.expr(f"TIMESTAMP_NTZ '{year}-01-01 00:00:00'")
        return df.select("domain", name.alias("name"), stamp.alias("created_at"), stamp.alias("updated_at"))

    base = shape(domains.filter("domain LIKE '%1%'"), F.lit("old"), 2023).withColumn("id", keys.source_key("domain"))
    batch = shape(domains.filter("domain LIKE '%2%'"), F.concat(F.lit("new "), "domain"), 2024)
    merged = G.list_sources(G.upsert_sources(base, batch))
    return merged.select("id", "domain", "name", F.year("created_at").alias("created"))


@query("""
SELECT event_id, event_type AS change_type, 'k' || (props->>'$.k') AS substance FROM events WHERE event_type <> 'view'
""")
def structured_updates(spark: SparkSession, sf: str) -> DataFrame:
    text = F.expr(
        "CASE WHEN event_type = 'view' THEN '{\"change_type\": \"\", \"substance_name\": \"x\"}' ELSE "
        "'{\"change_type\": \"' || event_type || '\", \"substance_name\": \"k' || get_json_object(props, '$.k') || '\"}' END"
    )
    rows = table(spark, sf, "events").select("event_id", structured_update(text).alias("u")).filter("u IS NOT NULL")
    return rows.select("event_id", F.col("u.change_type").alias("change_type"), F.col("u.substance_name").alias("substance"))
