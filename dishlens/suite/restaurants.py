"""Inspection import, life-cycle merges and operational reports over tables derived from orders,
customers, line items and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.functions.dates import inspection_time
from dishlens.operators import fold, merge as M
from dishlens.operators.dedup import latest_per_key
from dishlens.operators.filters import contains_text
from dishlens.operators.paging import page_bounds, paginate
from dishlens.operators.spread import spread_small
from dishlens.plans import restaurants as R
from dishlens.sources import inspections as N
from dishlens.suite.base import derive, derive_sql, query, table

# One restaurant per order.
RESTAURANT = {
    "id": "'id-' || o_orderkey",
    "camis": "CAST(o_orderkey AS STRING)",
    "dba": "'Cafe ' || o_custkey || ' ' || o_orderpriority",
    "status": "CASE o_orderpriority WHEN '1-URGENT' THEN 'scraped' WHEN '2-HIGH' THEN 'failed_scrape' "
              "WHEN '3-MEDIUM' THEN 'url_found' WHEN '4-NOT SPECIFIED' THEN 'pending_discovery' "
              "ELSE 'scraping' END",
    "address": "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'Street ' || o_custkey END",
    "phone": "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE '555-' || o_custkey END",
    "website_url": "CAST(NULL AS STRING)",
    "url_source": "CAST(NULL AS STRING)",
    "menu_urls": "CASE WHEN o_custkey % 3 = 0 THEN LIST() "
                 "ELSE LIST('https://r' || o_custkey || '.example.com/', "
                 "'https://r' || o_custkey || '.example.com/menu') END",
    "extraction_tier": "CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_orderstatus = 'F' THEN 'jsonld' "
                       "WHEN o_orderstatus = 'O' THEN 'image_ocr' ELSE NULL END",
    "item_count": "CAST(floor(o_totalprice / 10000) AS INT)",
    "scraped_at": "CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderdate END",
    "last_error": "CASE o_custkey % 5 WHEN 0 THEN 'no URL found for ' || o_orderkey || ' (attempt ' || "
                  "(o_custkey % 3) || '/3)' WHEN 1 THEN 'extract menu: fetch: status 403' "
                  "WHEN 2 THEN 'fetch: status 429 for r' || o_custkey WHEN 3 THEN '' END",
    "created_at": "o_orderdate",
    "updated_at": "o_orderdate",
}
_REST = f"restaurants AS ({derive_sql(RESTAURANT, 'orders')})"


def _restaurants(spark: SparkSession, sf: str) -> DataFrame:
    columns = dict(RESTAURANT)
    columns["menu_urls"] = columns["menu_urls"].replace("LIST()", "CAST(array() AS ARRAY<STRING>)")
    return derive(table(spark, sf, "orders"), columns)


# ---------------------------------------------------------------- import

# One inspection per line item; the key is the part, dates come in every accepted and one wrong form.
INSPECTION = {
    "camis": "CASE WHEN l_partkey % 11 = 0 THEN '' ELSE CAST(l_partkey AS STRING) END",
    "boro": "CASE WHEN l_suppkey % 9 = 0 THEN '0' ELSE 'Queens' END",
    "latitude": "CASE l_linenumber WHEN 1 THEN '40.7' WHEN 2 THEN '0' WHEN 3 THEN 'n/a' ELSE ' 41.25 ' END",
    "longitude": "'-73.9'",
    "nta": "CASE l_returnflag WHEN 'A' THEN 'QN70' WHEN 'R' THEN 'QN31' ELSE 'MN01' END",
    "zipcode": "CASE l_linestatus WHEN 'F' THEN '11101' ELSE '11377' END",
    "pos": "l_orderkey * 100000 + l_partkey * 7 + l_linenumber",
    "day": "date_format(l_shipdate, 'yyyy-MM-dd')",
    "usd": "date_format(l_shipdate, 'MM/dd/yyyy')",
    "shape": "l_suppkey % 4",
}
_DATED = (
    "CASE {s} WHEN 0 THEN {usd} WHEN 1 THEN {day} || 'T00:00:00Z' WHEN 2 THEN {day} || 'T00:00:00.000' "
    "ELSE {day} END"
)
_INSP = (
    "inspections AS (SELECT *, CASE WHEN shape < 3 THEN day END AS parsed, "
    + _DATED.format(s="shape", usd="usd", day="day") + " AS inspection_date FROM ("
    + derive_sql(INSPECTION, "lineitem")
    .replace("date_format(l_shipdate, 'yyyy-MM-dd')", "strftime(l_shipdate, '%Y-%m-%d')")
    .replace("date_format(l_shipdate, 'MM/dd/yyyy')", "strftime(l_shipdate, '%m/%d/%Y')")
    + ")), valid AS (SELECT * REPLACE (COALESCE(TRY_CAST(trim(latitude) AS DOUBLE), 0) AS latitude) "
    "FROM inspections WHERE camis <> '' AND boro <> '0' "
    "AND COALESCE(TRY_CAST(trim(latitude) AS DOUBLE), 0) <> 0)"
)


def _inspections(spark: SparkSession, sf: str) -> DataFrame:
    raw = derive(spread_small(table(spark, sf, "lineitem")), INSPECTION)
    raw = raw.withColumn("inspection_date", F.expr(_DATED.format(s="shape", usd="usd", day="day")))
    raw = raw.withColumn("latitude", F.trim("latitude"))
    return N.valid_records(raw)


@query(f"""
WITH {_INSP},
ranked AS (SELECT *, row_number() OVER (PARTITION BY camis ORDER BY parsed DESC NULLS LAST, pos) AS rn FROM valid)
SELECT camis, inspection_date, latitude, nta, pos FROM ranked WHERE rn = 1
""")
def latest_inspections(spark: SparkSession, sf: str) -> DataFrame:
    latest = N.latest_records(_inspections(spark, sf), position="pos")
    return latest.select("camis", "inspection_date", "latitude", "nta", "pos")


@query(f"""
WITH {_INSP}
SELECT nta, zipcode, count(*) AS n, count(parsed) AS dated FROM valid
WHERE (nta IN ('QN70', 'QN71', 'QN72', 'QN68') OR (nta = 'QN31' AND zipcode IN ('11101', '11109')))
  AND day > '1995-06-01'
GROUP BY 1, 2
""")
def area_inspections(spark: SparkSession, sf: str) -> DataFrame:
    records = _inspections(spark, sf).withColumnRenamed("day", "record_date")
    rows = N.area_records(records, "astoria-lic", since="1995-06-01", limit=None)
    return rows.groupBy("nta", "zipcode").agg(
        F.count(F.lit(1)).alias("n"), F.count(inspection_time("inspection_date")).alias("dated")
    )


@query("""
WITH ranked AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events)
SELECT user_id, event_id, event_type, ts FROM ranked WHERE rn = 1
""")
def latest_per_user(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    latest = latest_per_key(events, ["user_id"], [F.desc("ts"), F.asc("event_id")])
    return latest.select("user_id", "event_id", "event_type", "ts")


# ---------------------------------------------------------------- merges

# The base table holds what is open or done, the batch what is urgent, high or done.
_PARTS = f"""
{_REST},
base AS (SELECT r.* FROM restaurants r JOIN orders ON camis = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus <> 'P'),
batch AS (
  SELECT camis, 'New ' || dba AS dba, CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'Avenue ' || o_custkey END AS address,
         '777-' || o_custkey AS phone
  FROM restaurants JOIN orders ON camis = CAST(o_orderkey AS VARCHAR) WHERE o_orderstatus <> 'O')"""


def _base(spark: SparkSession, sf: str) -> DataFrame:
    columns = {**RESTAURANT, "menu_urls": "CAST(NULL AS ARRAY<STRING>)"}
    return derive(table(spark, sf, "orders").filter("o_orderstatus <> 'P'"), columns)


def _batch(spark: SparkSession, sf: str) -> DataFrame:
    return derive(table(spark, sf, "orders").filter("o_orderstatus <> 'O'"), {
        "camis": RESTAURANT["camis"],
        "dba": "'New ' || " + RESTAURANT["dba"],
        "address": "CASE WHEN o_custkey % 2 = 0 THEN NULL ELSE 'Avenue ' || o_custkey END",
        "phone": "'777-' || o_custkey",
    })


@query(f"""
WITH {_PARTS}
SELECT COALESCE(b.camis, n.camis) AS camis, COALESCE(n.dba, b.dba) AS dba,
       CASE WHEN n.camis IS NULL THEN b.address ELSE COALESCE(n.address, b.address) END AS address,
       COALESCE(n.phone, b.phone) AS phone, COALESCE(b.status, 'pending_discovery') AS status, b.item_count
FROM base b FULL JOIN batch n ON b.camis = n.camis
""")
def merge_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    empty = {c: F.lit(None).cast("string") for c in
             ("boro", "building", "street", "zipcode", "cuisine", "nta")}
    numbers = {c: F.lit(None).cast("double") for c in ("latitude", "longitude")}
    base = _base(spark, sf).withColumns({**empty, **numbers})
    batch = _batch(spark, sf).withColumns({**empty, **numbers})
    merged = R.upsert_inspected(base, batch, F.concat(F.lit("new-"), "camis"))
    return merged.select("camis", "dba", "address", "phone", "status", "item_count")


@query(f"""
WITH {_PARTS}
SELECT COALESCE(b.camis, n.camis) AS camis, COALESCE(n.dba, b.dba) AS dba,
       CASE WHEN n.camis IS NULL THEN b.address ELSE n.address END AS address,
       CASE WHEN n.camis IS NULL THEN b.phone ELSE n.phone END AS phone
FROM base b FULL JOIN batch n ON b.camis = n.camis
""")
def merge_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["camis", "dba", "address", "phone"]
    return M.merge_upsert(_base(spark, sf).select(columns), _batch(spark, sf), ["camis"])


@query(f"""
WITH {_PARTS}
SELECT camis, dba, phone FROM base
UNION ALL SELECT camis, dba, phone FROM batch WHERE camis NOT IN (SELECT camis FROM base)
""")
def merge_insert_absent(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["camis", "dba", "phone"]
    return M.insert_absent(_base(spark, sf).select(columns), _batch(spark, sf).select(columns), ["camis"])


@query(f"""
WITH {_PARTS} SELECT camis, dba FROM base WHERE camis NOT IN (SELECT camis FROM batch)
""")
def merge_delete(spark: SparkSession, sf: str) -> DataFrame:
    return M.delete_keys(_base(spark, sf).select("camis", "dba"), _batch(spark, sf), ["camis"])


@query(f"""
WITH {_PARTS}
SELECT 'create' AS op, n.camis, CASE WHEN b.camis IS NULL THEN 'applied' ELSE 'conflict' END AS outcome
FROM batch n LEFT JOIN base b ON b.camis = n.camis
UNION ALL
SELECT 'update', n.camis, CASE WHEN b.camis IS NULL THEN 'not found' ELSE 'applied' END
FROM batch n LEFT JOIN base b ON b.camis = n.camis
""")
def strict_create_update(spark: SparkSession, sf: str) -> DataFrame:
    judged = M.strict_outcomes(_base(spark, sf), _batch(spark, sf).select("camis"), ["camis"])
    return judged.unpivot(["camis"], ["create", "update"], "op", "outcome").select("op", "camis", "outcome")


@query("""
WITH base AS (SELECT l_orderkey AS review_id, l_partkey AS chunk FROM lineitem WHERE l_returnflag <> 'N'),
fresh AS (SELECT l_orderkey AS review_id, l_partkey AS chunk FROM lineitem WHERE l_returnflag = 'N')
SELECT review_id, count(*) AS chunks, CAST(sum(chunk) AS BIGINT) AS total FROM (
  SELECT * FROM base WHERE review_id NOT IN (SELECT review_id FROM fresh) UNION ALL SELECT * FROM fresh)
GROUP BY 1
""")
def merge_replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("review_id"), F.col("l_partkey").alias("chunk"), "l_returnflag"
    )
    base = lines.filter("l_returnflag <> 'N'").drop("l_returnflag")
    fresh = lines.filter("l_returnflag = 'N'").drop("l_returnflag")
    merged = M.replace_children(base, fresh, fresh, "review_id")
    return merged.groupBy("review_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("chunk").alias("total")
    )


@query(f"""
WITH {_REST},
outside AS (SELECT 'y' || c_custkey AS yelp_id, c_name AS dba, c_nationkey FROM customer),
base AS (SELECT camis, NULL AS yelp_id, dba, status FROM restaurants
         UNION ALL SELECT NULL, yelp_id, dba, 'failed_scrape' FROM outside WHERE c_nationkey < 10),
batch AS (SELECT yelp_id, 'Y ' || dba AS dba FROM outside WHERE c_nationkey > 5)
SELECT camis, yelp_id, dba, status FROM base WHERE yelp_id IS NULL
UNION ALL
SELECT NULL, COALESCE(b.yelp_id, n.yelp_id), COALESCE(n.dba, b.dba), COALESCE(b.status, 'scraped')
FROM (SELECT * FROM base WHERE yelp_id IS NOT NULL) b FULL JOIN batch n ON b.yelp_id = n.yelp_id
""")
def merge_outside_ids(spark: SparkSession, sf: str) -> DataFrame:
    outside = table(spark, sf, "customer").select(
        F.concat(F.lit("y"), "c_custkey").alias("business_id"), F.col("c_name").alias("name"), "c_nationkey"
    )
    known = outside.filter("c_nationkey < 10").select(
        F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("camis"),
        F.col("business_id").alias("yelp_id"), F.col("name").alias("dba"),
        F.lit("failed_scrape").alias("status"),
    )
    base = _restaurants(spark, sf).select(
        "id", "camis", F.lit(None).cast("string").alias("yelp_id"), "dba", "status"
    ).unionByName(known)
    batch = outside.filter("c_nationkey > 5").withColumn("name", F.concat(F.lit("Y "), "name"))
    return R.upsert_outside(base, batch).select("camis", "yelp_id", "dba", "status")


# Discovery results for every restaurant of an even customer.
_FOUND = {
    "camis": "CAST(o_orderkey AS STRING)",
    "website_url": "CASE o_custkey % 5 WHEN 0 THEN '' ELSE 'https://r' || o_custkey || '.example.com' END",
    "first_url": "CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE 'https://r' || o_custkey || '/m' END",
    "url_source": "CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'gemini' END",
    "address": "CASE WHEN o_custkey % 3 = 1 THEN '' ELSE 'Found ' || o_custkey END",
    "phone": "''",
}


@query(f"""
WITH {_REST}, found AS ({derive_sql(_FOUND, "orders WHERE o_orderstatus <> 'O'")})
SELECT r.camis,
       CASE WHEN f.camis IS NULL THEN r.website_url ELSE NULLIF(f.website_url, '') END AS website_url,
       CASE WHEN f.camis IS NULL THEN CAST(len(r.menu_urls) AS INTEGER)
            WHEN f.first_url IS NULL THEN 0 ELSE 1 END AS n_urls,
       CASE WHEN f.camis IS NULL THEN r.url_source ELSE NULLIF(f.url_source, '') END AS url_source,
       COALESCE(NULLIF(f.address, ''), r.address) AS address, COALESCE(NULLIF(f.phone, ''), r.phone) AS phone,
       CASE WHEN f.camis IS NULL THEN r.status
            WHEN f.website_url <> '' OR f.first_url IS NOT NULL THEN 'url_found'
            ELSE 'failed_permanently' END AS status
FROM restaurants r LEFT JOIN found f ON r.camis = f.camis
""")
def discovery_update(spark: SparkSession, sf: str) -> DataFrame:
    found = derive(table(spark, sf, "orders").filter("o_orderstatus <> 'O'"), _FOUND)
    found = found.withColumn("menu_urls", F.array_compact(F.array("first_url")))
    merged = R.apply_discovery(_restaurants(spark, sf), found)
    return merged.select(
        "camis", "website_url", F.size("menu_urls").alias("n_urls"), "url_source", "address", "phone", "status"
    )


@query(f"""
WITH {_REST}, tiers AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS camis, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'pdf' END AS tier
  FROM orders WHERE o_orderstatus = 'F')
SELECT r.camis, CASE WHEN t.camis IS NULL THEN r.extraction_tier ELSE NULLIF(t.tier, '') END AS extraction_tier
FROM restaurants r LEFT JOIN tiers t ON r.camis = t.camis
""")
def tier_update(spark: SparkSession, sf: str) -> DataFrame:
    tiers = table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr(
        "CAST(o_orderkey AS STRING) AS camis",
        "CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'pdf' END AS extraction_tier",
    )
    return R.set_tiers(_restaurants(spark, sf), tiers).select("camis", "extraction_tier")


# ---------------------------------------------------------------- state fold

SCRAPE_EVENT = {
    "camis": "CAST(user_id AS STRING)",
    "seq": "event_id",
    "ts": "ts",
    "status": "CASE event_type WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'scraped' ELSE 'scraping' END "
              "WHEN 'click' THEN 'scraping' WHEN 'error' THEN 'failed_scrape' WHEN 'view' THEN 'scraping' "
              "ELSE 'url_found' END",
    "item_count": "CAST(floor(value) AS INT)",
    "last_error": "CASE WHEN event_type = 'error' THEN 'status ' || event_id ELSE '' END",
}
# Base rows exist for every user but the last ten; some start scraped or scraping.
_FOLD_BASE = {
    "camis": "CAST(user_id AS STRING)",
    "status": "CASE user_id % 5 WHEN 0 THEN 'scraped' WHEN 1 THEN 'scraping' ELSE 'url_found' END",
    "item_count": "CAST(user_id % 13 AS INT)",
    "last_error": "CASE WHEN user_id % 2 = 0 THEN 'old' END",
    "scraped_at": "CAST(NULL AS TIMESTAMP)",
}


@query(f"""
WITH RECURSIVE ev AS (
  SELECT *, row_number() OVER (PARTITION BY camis ORDER BY seq) AS n FROM ({derive_sql(SCRAPE_EVENT, "events")})),
base AS ({derive_sql(_FOLD_BASE, "(SELECT DISTINCT user_id FROM events WHERE event_type <> 'signup')")}),
fold AS (
  SELECT camis, status, item_count, last_error, scraped_at, CAST(0 AS BIGINT) AS n FROM base
  UNION ALL
  SELECT f.camis,
         CASE WHEN f.status = 'scraped' AND e.status <> 'scraped' THEN f.status ELSE e.status END,
         CASE WHEN f.status = 'scraped' AND e.status <> 'scraped' THEN f.item_count
              WHEN e.status = 'scraped' AND f.status IN ('scraped', 'scraping') THEN f.item_count + e.item_count
              ELSE e.item_count END,
         CASE WHEN f.status = 'scraped' AND e.status <> 'scraped' THEN f.last_error ELSE NULLIF(e.last_error, '') END,
         CASE WHEN e.status = 'scraped' THEN e.ts ELSE f.scraped_at END,
         e.n
  FROM fold f JOIN ev e ON e.camis = f.camis AND e.n = f.n + 1)
SELECT camis, status, item_count, last_error, scraped_at FROM fold
QUALIFY row_number() OVER (PARTITION BY camis ORDER BY n DESC) = 1
""")
def scrape_state_fold(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    users = events.filter("event_type <> 'signup'").select("user_id").distinct()
    columns = {**_FOLD_BASE, "scraped_at": "CAST(NULL AS TIMESTAMP_NTZ)"}
    return fold.fold_scrape_results(derive(users, columns), derive(events, SCRAPE_EVENT))


# ---------------------------------------------------------------- listings and reports

@query(f"""
WITH {_REST} SELECT status, count(*) AS n, CAST(COALESCE(sum(item_count), 0) AS BIGINT) AS items
FROM restaurants GROUP BY 1
""")
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.status_counts(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT count(*) AS total, CAST(COALESCE(sum(item_count), 0) AS BIGINT) AS total_items FROM restaurants
""")
def pipeline_totals(spark: SparkSession, sf: str) -> DataFrame:
    return R.pipeline_totals(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT extraction_tier AS tier, count(*) AS n, CAST(COALESCE(sum(item_count), 0) AS BIGINT) AS items
FROM restaurants WHERE status = 'scraped' AND extraction_tier IS NOT NULL AND extraction_tier <> '' GROUP BY 1
""")
def tier_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.tier_counts(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT COALESCE(extraction_tier, '(none)') AS tier, count(*) AS n,
  CAST(COALESCE(sum(item_count), 0) AS BIGINT) AS items FROM restaurants WHERE status = 'scraped' GROUP BY 1
""")
def tier_counts_all(spark: SparkSession, sf: str) -> DataFrame:
    return R.tier_counts(_restaurants(spark, sf), with_none=True)


@query(f"""
WITH {_REST}
SELECT substring(regexp_replace(split_part(last_error, ':', 1), '[0-9]+', 'N', 'g'), 1, 80) AS reason, count(*) AS n
FROM restaurants WHERE status = 'failed_scrape' AND last_error IS NOT NULL AND last_error <> ''
GROUP BY 1 ORDER BY n DESC, reason LIMIT 10
""")
def failure_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    return R.failure_taxonomy(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT last_error, count(*) AS n FROM restaurants WHERE status = 'failed_scrape' GROUP BY 1
""")
def error_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.error_counts(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT CASE WHEN item_count = 0 THEN '0' WHEN item_count < 10 THEN '1-9'
  WHEN item_count < 30 THEN '10-29' ELSE '30+' END AS bucket, count(*) AS n
FROM restaurants WHERE status = 'scraped' GROUP BY 1
""")
def item_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return R.item_histogram(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT camis, dba, last_error FROM restaurants
WHERE status = 'failed_scrape' AND (last_error LIKE '%status 403%' OR last_error LIKE '%status 429%')
""")
def anti_bot_failures(spark: SparkSession, sf: str) -> DataFrame:
    return R.anti_bot_failures(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT camis, dba, status, CAST(NULLIF(len(menu_urls), 0) AS INTEGER) AS url_count
FROM restaurants WHERE status <> 'scraped'
""")
def open_work(spark: SparkSession, sf: str) -> DataFrame:
    return R.open_work(_restaurants(spark, sf))


@query(f"""
WITH {_REST},
links AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS camis, 'https://r' || o_custkey || '.example.com' ||
    CASE WHEN o_orderkey % 2 = 0 THEN '/menu/' ELSE '/order' END AS link FROM orders),
stored AS (SELECT camis, regexp_replace(unnest(menu_urls), '/$', '') AS key FROM restaurants)
SELECT l.camis, r.item_count, l.link
FROM links l JOIN restaurants r ON r.camis = l.camis
WHERE extraction_tier = 'image_ocr' AND item_count BETWEEN 1 AND 3
  AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.camis = l.camis AND s.key = regexp_replace(l.link, '/$', ''))
""")
def partial_extractions(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "orders").selectExpr(
        "CAST(o_orderkey AS STRING) AS camis",
        "'https://r' || o_custkey || '.example.com' || "
        "CASE WHEN o_orderkey % 2 = 0 THEN '/menu/' ELSE '/order' END AS link",
    )
    return R.partial_extractions(_restaurants(spark, sf), links)


@query(f"""
WITH {_REST} SELECT camis, dba,
  CASE WHEN len(menu_urls) > 0 THEN 'scrape' ELSE 'discover' END AS action,
  CASE WHEN len(menu_urls) > 0 THEN 'url_found' ELSE 'pending_discovery' END AS next_status
FROM restaurants WHERE status = 'failed_scrape'
""")
def retry_actions(spark: SparkSession, sf: str) -> DataFrame:
    return R.retry_actions(_restaurants(spark, sf))


@query(f"""
WITH {_REST} SELECT camis, dba,
  CASE WHEN len(menu_urls) > 0 AND status <> 'pending_discovery' THEN 'scrape' ELSE 'discover' END AS action,
  CASE WHEN len(menu_urls) > 0 AND status <> 'pending_discovery' THEN 'url_found' ELSE 'pending_discovery' END AS next_status
FROM restaurants
""")
def retry_actions_listing(spark: SparkSession, sf: str) -> DataFrame:
    return R.retry_actions(_restaurants(spark, sf), listing=True)


@query(f"""
WITH {_REST} SELECT camis, dba, status, created_at FROM restaurants
WHERE status = 'scraped' AND dba ILIKE '%cafe 1%' ORDER BY created_at DESC NULLS FIRST, id LIMIT 30 OFFSET 30
""")
def restaurant_page(spark: SparkSession, sf: str) -> DataFrame:
    offset, limit = page_bounds("2", "30", default=50, cap=200)
    page = R.list_restaurants(_restaurants(spark, sf), "scraped", "cafe 1", offset, limit)
    return page.select("camis", "dba", "status", "created_at")


@query(f"""
WITH {_REST} SELECT count(*) AS total FROM restaurants WHERE status = 'scraped' AND dba ILIKE '%cafe 1%'
""")
def restaurant_total(spark: SparkSession, sf: str) -> DataFrame:
    return R.count_restaurants(_restaurants(spark, sf), "scraped", "cafe 1")


@query("SELECT COALESCE(max(o_orderdate), TIMESTAMP '1970-01-01') AS since FROM orders")
def high_water(spark: SparkSession, sf: str) -> DataFrame:
    return R.high_water(_restaurants(spark, sf))


# ---------------------------------------------------------------- jobs

JOB = {
    "id": "event_id",
    "kind": "CASE event_type WHEN 'click' THEN 'menusearch.scrape_menu' WHEN 'view' THEN "
            "'menusearch.discover_menu_url' WHEN 'error' THEN 'menusearch.scrape_menu' ELSE 'other' END",
    "state": "CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'retryable' WHEN 2 THEN 'scheduled' "
             "WHEN 3 THEN 'discarded' ELSE 'available' END",
    "args": "'{\"camis\": \"' || user_id || '\", \"k\": 1}'",
    "errors": "'[{\"error\": \"first\"}, {\"error\": \"e' || (event_id % 9) || '\"}]'",
    "scheduled_at": "ts",
    "finalized_at": "CASE WHEN event_id % 5 IN (0, 3) THEN ts END",
    "final_attempt_at": "CASE WHEN event_id % 3 > 0 THEN ts END",
}
_JOBS = f"jobs AS ({derive_sql(JOB, 'events')})"


def _jobs(spark: SparkSession, sf: str) -> DataFrame:
    return derive(table(spark, sf, "events"), JOB)


@query(f"""
WITH {_JOBS} SELECT kind, state, count(*) AS n FROM jobs
WHERE kind IN ('menusearch.discover_menu_url', 'menusearch.scrape_menu')
  AND (finalized_at IS NULL OR finalized_at > TIMESTAMP '2024-01-20 12:00:00' - INTERVAL '24' HOUR)
GROUP BY 1, 2
""")
def job_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.job_counts(_jobs(spark, sf), F.expr("TIMESTAMP_NTZ '2024-01-20 12:00:00'"))


@query(f"""
WITH {_JOBS} SELECT kind, count(*) AS n, min(scheduled_at) AS first_at, max(scheduled_at) AS last_at
FROM jobs WHERE state = 'scheduled' GROUP BY 1
""")
def scheduled_backlog(spark: SparkSession, sf: str) -> DataFrame:
    return R.scheduled_backlog(_jobs(spark, sf))


@query(f"""
WITH {_JOBS} SELECT id, args->>'$.camis' AS camis, errors->>'$[#-1].error' AS last_error
FROM jobs WHERE kind = 'menusearch.scrape_menu' AND state = 'retryable'
""")
def job_errors(spark: SparkSession, sf: str) -> DataFrame:
    return R.job_errors(_jobs(spark, sf), "menusearch.scrape_menu", "retryable", "camis")


@query(f"""
WITH {_JOBS} SELECT id, kind, final_attempt_at FROM jobs WHERE state = 'discarded'
ORDER BY final_attempt_at DESC NULLS LAST, id LIMIT 100
""")
def discarded_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return R.discarded_jobs(_jobs(spark, sf), 100).select("id", "kind", "final_attempt_at")


@query(f"""
WITH {_REST}, urls AS (
  SELECT camis, unnest(menu_urls) AS url, generate_subscripts(menu_urls, 1) - 1 AS pos FROM restaurants)
SELECT camis, url, CAST(pos AS INTEGER) AS pos, TIMESTAMP '2024-02-01 00:00:00' + to_seconds(pos * 15) AS scheduled_at FROM urls
""")
def staggered_schedule(spark: SparkSession, sf: str) -> DataFrame:
    return R.staggered_schedule(_restaurants(spark, sf), F.expr("TIMESTAMP_NTZ '2024-02-01 00:00:00'"))


@query("""
SELECT user_id, event_type, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS period, min(ts) AS ts, count(*) AS merged
FROM events GROUP BY 1, 2, 3
""")
def unique_within_period(spark: SparkSession, sf: str) -> DataFrame:
    return R.unique_in_period(table(spark, sf, "events"), ["user_id", "event_type"], "ts", 7 * 24 * 3600)


# ---------------------------------------------------------------- page of a plain listing

@query("""
SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%ring%'
ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20
""")
def page_list(spark: SparkSession, sf: str) -> DataFrame:
    offset, limit = page_bounds("2", None)
    rows = table(spark, sf, "part").filter(contains_text("ring", "p_name"))
    page = paginate(rows, [F.asc("p_name"), F.asc("p_partkey")], offset, limit)
    return page.select("p_partkey", "p_name", "p_brand")


@query("SELECT count(*) AS total FROM part WHERE p_name ILIKE '%ring%'")
def page_total(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").filter(contains_text("ring", "p_name")).agg(
        F.count(F.lit(1)).alias("total")
    )
