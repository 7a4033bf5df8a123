"""Sources, sinks and merges run for real: tables are written to the shared folder and read back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens import schemas
from dishlens.functions.vectors import certainty, norm
from dishlens.operators import knn, merge as M
from dishlens.plans import indexing as I, restaurants as R
from dishlens.sources import events as E, inspections as N
from dishlens.streaming import jobs as J
from dishlens.suite.base import ORACLES, derive, derive_sql, query, table
from dishlens.suite.search import _CENTROIDS, _QUERY_VECTOR, _centroids, _query_vector, _rounded
from dishlens.suite.streams import _run_folder, _stream

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


# ---------------------------------------------------------------- files

@query(f"""
SELECT CAST(doc_id AS VARCHAR) AS camis, md5(trim(COALESCE(text, ''), {_BLANKS})) AS dba, source AS cuisine,
  CAST(doc_id % 5 AS VARCHAR) AS boro, CAST(doc_id % 7 AS DOUBLE) AS latitude
FROM documents WHERE doc_id % 17 > 0 AND doc_id % 5 > 0 AND doc_id % 7 > 0
""")
def inspection_csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Names are whole texts, with quotes and line breaks; some rows lack their key, borough or place."""
    path = f"{_run_folder(spark)}/csv"
    key = F.when(F.col("doc_id") % 17 > 0, F.concat(F.lit(" "), "doc_id"))
    rows = table(spark, sf, "documents").select(
        F.col("text").alias("dba"), key.alias("camis"), (F.col("doc_id") % 5).cast("string").alias("boro"),
        (F.col("doc_id") % 7).cast("string").alias("latitude"), F.col("source").alias("cuisine_description"),
    )
    rows.write.csv(path, header=True, escape='"')
    found = N.restaurant_rows(N.valid_records(N.read_csv(spark, path)))
    return found.select("camis", F.md5("dba").alias("dba"), "cuisine", "boro", "latitude")


@query("""
SELECT CAST(doc_id AS VARCHAR) AS review_id, source AS business_id, CAST(doc_id % 5 + 0.5 AS DOUBLE) AS stars,
  CAST(doc_id % 3 AS DOUBLE) AS useful, md5(text) AS text
FROM documents
""")
def review_events_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """A batch written twice is there once."""
    path = f"{_run_folder(spark)}/reviews"
    reviews = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("review_id"), F.lit("").alias("user_id"),
        F.col("source").alias("business_id"), (F.col("doc_id") % 5 + 0.5).alias("stars"),
        (F.col("doc_id") % 3).alias("useful"), F.lit(0).alias("funny"), F.lit(0).alias("cool"), "text",
    )
    for _ in range(2):
        E.write_review_events(reviews, path, batch=0)
    found = E.read_events(spark, path, schemas.REVIEW_EVENT)
    return found.select(
        "review_id", "business_id", F.col("stars").cast("double").alias("stars"),
        F.col("useful").cast("double").alias("useful"), F.md5("text").alias("text"),
    )


@query("""
SELECT CAST(c_custkey AS VARCHAR) AS camis, c_name AS dba, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS action,
  CASE WHEN c_custkey % 3 > 0 THEN c_acctbal ELSE 0 END AS latitude
FROM customer
""")
def inspection_events_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every third record is in an older file that lacks columns; a finished day is left alone."""
    path = f"{_run_folder(spark)}/bronze"
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("camis"), F.col("c_name").alias("dba"),
        F.col("c_mktsegment").alias("action"), F.col("c_acctbal").alias("latitude"),
    )
    old = F.col("camis").cast("long") % 3 == 0
    E.write_inspection_bronze(rows.filter(old).drop("action", "latitude"), path, "a", "2020-01-01")
    for _ in range(2):
        E.write_inspection_bronze(rows.filter(~old), path, "a", "2020-01-02")
    return E.inspection_events(spark, path).select("camis", "dba", "action", "latitude")


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS business_id, CAST(o_orderkey AS VARCHAR) AS source_url, o_orderpriority AS dish_name,
  CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END AS price, CAST(0 AS INTEGER) AS n_modifiers
FROM orders
""")
def menu_events_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """NULL lists come back empty, an absent price stays absent; older files name the key `camis`."""
    path = f"{_run_folder(spark)}/silver"
    entry = (
        "named_struct('menu_item_id', '', 'dish_name', o_orderpriority, 'description', '', 'menu_section', '', "
        "'price', CASE WHEN o_orderkey % 4 > 0 THEN o_totalprice END, 'stated_ingredients', NULL, "
        "'has_full_ingredients', false, 'modifiers', NULL, 'source_url', '', 'scraped_at', '')"
    )
    events = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("business_id"), F.col("o_orderkey").cast("string").alias("source_url"),
        F.expr(f"array({entry})").cast(f"array<{schemas.MENU_ENTRY}>").alias("items"),
    )
    old = F.col("source_url").cast("long") % 2 == 0
    E.write_menu_events(events.filter(~old), path, batch=0)
    E.write_menu_events(
        events.filter(old).select(F.col("business_id").alias("camis"), "source_url", "items"), path, batch=1
    )
    return E.menu_events(spark, path).select("business_id", F.col("source_url").alias("url"), F.inline("items")).select(
        "business_id", F.col("url").alias("source_url"), "dish_name", "price",
        F.size("modifiers").alias("n_modifiers"),
    )


@query("""
SELECT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS domain, strftime(DATE '2024-01-01' + CAST(page_id % 3 AS INTEGER), '%Y-%m-%d') AS scrape_date,
  page_id, md5(html) AS html
FROM pages
""")
def raw_pages_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_run_folder(spark)}/raw"
    pages = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("domain"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 3).cast("int")), "yyyy-MM-dd").alias("scrape_date"),
        "page_id", "html",
    )
    for _ in range(2):
        E.write_raw_pages(pages, path, batch=7)
    found = spark.read.schema("page_id LONG, html STRING, batch INT, domain STRING, scrape_date STRING").parquet(path)
    return found.select("domain", "scrape_date", "page_id", F.md5("html").alias("html"))


@query("""
SELECT 'tier' AS job_kind, CAST(o_custkey AS VARCHAR) AS camis, count(*) AS n, 'not found' AS error
FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 2
""")
def dead_letter_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of unknown keys end in the dead letters, once however often the batch runs."""
    path = f"{_run_folder(spark)}/letters"
    base = table(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("camis"))
    batch = table(spark, sf, "orders").select(F.col("o_custkey").alias("camis"), "o_orderkey")
    rejected = M.strict_update(base, batch, ["camis"])[1]
    for _ in range(2):
        E.append_dead_letters(rejected, path, "tier", batch=0)
    letters = spark.read.schema("job_kind STRING, job_args STRING, error STRING, batch INT").parquet(path)
    key = F.get_json_object("job_args", "$.camis").alias("camis")
    return letters.groupBy("job_kind", key, "error").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS records, 'cool,funny' AS missing FROM documents")
def event_schema_check(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{_run_folder(spark)}/part"
    table(spark, sf, "documents").selectExpr(
        "doc_id AS review_id", "'' AS user_id", "source AS business_id", "0 AS stars", "0 AS useful", "text"
    ).write.parquet(path)
    found = E.check_schema(spark.read.parquet(path), schemas.REVIEW_EVENT)
    return found.select("records", F.array_join(F.array_sort("missing"), ",").alias("missing"))


# ---------------------------------------------------------------- merges of the index

def _review_rows(spark: SparkSession, sf: str, which: str) -> DataFrame:
    return table(spark, sf, "documents").filter(which).selectExpr(
        "doc_id div 2 AS review_id", "source AS business_id", "md5(text) AS text"
    )


@query("""
WITH base AS (SELECT doc_id // 2 AS review_id, source AS business_id, md5(text) AS text FROM documents WHERE doc_id % 4 = 0),
batch AS (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY business_id DESC NULLS LAST, text DESC NULLS LAST) AS rn
  FROM (SELECT doc_id // 2 AS review_id, source AS business_id, md5(text) AS text FROM documents WHERE doc_id % 3 > 0))
SELECT review_id, business_id, text FROM batch WHERE rn = 1
UNION ALL SELECT * FROM base WHERE review_id NOT IN (SELECT review_id FROM batch)
""")
def review_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The batch repeats keys; one row of each stays."""
    return I.upsert_reviews(_review_rows(spark, sf, "doc_id % 4 = 0"), _review_rows(spark, sf, "doc_id % 3 > 0"))


@query("""
SELECT doc_id AS review_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE g END AS INTEGER) AS chunk_ix,
  CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS chunk_text
FROM documents, range(3) t(g) WHERE doc_id % 3 > 0 OR (doc_id % 2 = 0 AND g = 0)
""")
def chunk_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Every third review is indexed anew: the even ones to one chunk, the others to none."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"))
    stored = docs.select("review_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("chunk_ix"), F.lit("old").alias("chunk_text"))
    touched = docs.filter("review_id % 3 = 0")
    fresh = touched.filter("review_id % 2 = 0").select("review_id", F.lit(0).alias("chunk_ix"), F.lit("new").alias("chunk_text"))
    return I.upsert_chunks(stored, touched, fresh)


_IMPORT = {
    "camis": "CAST(o_custkey AS STRING)", "dba": "o_orderpriority || '-' || CAST(o_orderkey AS STRING)",
    "changed": "o_orderdate",
}


@query(f"""
WITH source AS ({derive_sql(_IMPORT, 'orders')}),
first AS (SELECT camis, max(dba) AS dba FROM source WHERE changed < TIMESTAMP '1996-01-01' GROUP BY 1),
later AS (SELECT camis, max(dba) AS dba FROM source WHERE changed > TIMESTAMP '1996-01-01' GROUP BY 1)
SELECT COALESCE(l.camis, f.camis) AS camis, COALESCE(l.dba, f.dba) AS dba,
  CASE WHEN f.camis IS NULL THEN '2001-01-01' ELSE '1996-01-01' END AS created,
  CASE WHEN l.camis IS NULL THEN '1996-01-01' ELSE '2001-01-01' END AS updated
FROM first f FULL JOIN later l ON l.camis = f.camis
""")
def import_since_high_water(spark: SparkSession, sf: str) -> DataFrame:
    """Two imports: the second takes what has changed after the change time that the first left."""
    source = derive(table(spark, sf, "orders"), _IMPORT).withColumn("changed", F.col("changed").cast("timestamp"))
    for name in R.IMPORT_COLUMNS[1:]:
        source = source.withColumn(name, F.lit(None).cast("double" if name in ("latitude", "longitude") else "string"))
    empty = spark.createDataFrame([], schemas.RESTAURANT)
    first = R.upsert_inspected(empty, source.filter("changed < '1996-01-01'"), as_of=F.lit("1996-01-01").cast("timestamp"))
    path = f"{_run_folder(spark)}/restaurants"
    first.write.parquet(path)
    base = spark.read.schema(schemas.RESTAURANT).parquet(path)
    rest = J.since_high_water(source, base, "changed", F.col("updated_at"))
    merged = R.upsert_inspected(base, rest, as_of=F.lit("2001-01-01").cast("timestamp"))
    day = [F.date_format(c, "yyyy-MM-dd").alias(n) for c, n in (("created_at", "created"), ("updated_at", "updated"))]
    return merged.select("camis", "dba", *day)


# ---------------------------------------------------------------- neighbours: wide vectors, blocks, stored lengths

_WIDE_SQL = "flatten([embedding, embedding, embedding, embedding, embedding, embedding, r, r, r, r, r, r])::DOUBLE[]"


@query(f"""
WITH wide AS (SELECT vec_id, {_WIDE_SQL} AS v FROM (SELECT *, list_reverse(embedding) AS r FROM embeddings)),
scored AS (SELECT vec_id, list_cosine_similarity(v, (SELECT v FROM wide WHERE vec_id = 0)) AS s FROM wide)
SELECT vec_id, round(s, 6) AS certainty FROM scored ORDER BY s DESC, vec_id LIMIT 25
""")
def nearest_topk_wide(spark: SparkSession, sf: str) -> DataFrame:
    """768 numbers a vector, scored by one product per Arrow batch."""
    wide = table(spark, sf, "embeddings").select(
        "vec_id",
        F.flatten(F.concat(F.array_repeat("embedding", 6), F.array_repeat(F.reverse("embedding"), 6))).alias("v"),
    )
    probe = _query_vector(spark, sf)
    return _rounded(knn.nearest(wide, "v", probe * 6 + probe[::-1] * 6, 25, "vec_id").select("vec_id", "certainty"))


@query(ORACLES["nearest_topk_batch"])
def nearest_topk_batch_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """More queries than may travel to a task: blocks of them meet shards of the table."""
    probes = _centroids(spark, sf).withColumnRenamed("label", "query_id")
    return _rounded(knn.nearest_batch(
        table(spark, sf, "embeddings"), "embedding", "vec_id", probes, "q", "query_id", 5, max_query_cells=64, dim=64
    ))


@query(f"""
WITH {_CENTROIDS},
near AS (
  SELECT e.vec_id AS item_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.q) AS s
  FROM embeddings e, centroids c)
SELECT item_id, label, round(s, 6) AS certainty FROM near
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY s DESC, label) = 1
""")
def catalog_match_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A catalog too large to travel: the block search answers."""
    items = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    return _rounded(knn.nearest_match(
        items, "embedding", "item_id", _centroids(spark, sf), "q", "label", max_cells=64, dim=64
    ))


@query(f"""
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 6) AS certainty FROM embeddings
""")
def certainty_stored_norm(spark: SparkSession, sf: str) -> DataFrame:
    """The length that the index stores saves a fold per row."""
    stored = table(spark, sf, "embeddings").withColumn("norm", norm(F.col("embedding")))
    return _rounded(stored.select("vec_id", certainty("embedding", _query_vector(spark, sf), "norm").alias("certainty")))


# ---------------------------------------------------------------- chunks, index and stream against SQL

_LETTERS = r"[^\p{L}\p{N}]+"


@query(r"""
SELECT doc_id, md5(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS letters, TRUE AS fits,
  length(text) <= 400 AS one_chunk
FROM documents WHERE text IS NOT NULL
""")
def chunk_letters(spark: SparkSession, sf: str) -> DataFrame:
    """Without overlap the chunks hold every letter of a text once and in order, and none is too long."""
    reviews = table(spark, sf, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("review_id"), "text")
    cut = I.review_chunks(reviews, 400, 0)
    # one text's chunks are its own size at most
    whole = F.array_sort(F.collect_list(F.struct("chunk_ix", "chunk_text")))
    joined = F.concat_ws("", F.transform(whole, lambda c: c["chunk_text"]))
    return cut.groupBy(F.col("review_id").alias("doc_id")).agg(
        F.md5(F.regexp_replace(joined, _LETTERS, "")).alias("letters"),
        (F.max(F.char_length("chunk_text")) <= 400).alias("fits"), (F.count(F.lit(1)) == 1).alias("one_chunk"),
    )


def letter_counts(texts: Sequence[str]) -> list[list[float]]:
    """An embedder SQL can follow: length of the text and how often it has some letters."""
    return [[float(len(t)), *(float(t.count(c)) for c in "aeinrt")] for t in texts]


_COUNTS = ", ".join(f"length(c) - length(replace(c, '{c}', ''))" for c in "aeinrt")
_INDEX_SQL = ORACLES["chunk_words"].rsplit("SELECT doc_id, ix AS chunk_ix", 1)[0] + f"""
, chunks AS (
  SELECT doc_id, ix, COALESCE(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY ix), 100), '') || piece AS c
  FROM cut WHERE ix >= 0),
counted AS (SELECT *, [length(c), {_COUNTS}] AS v FROM chunks)
SELECT doc_id AS review_id, ix AS chunk_ix, array_to_string(v, ',') AS counts,
  round(sqrt(list_dot_product(v::DOUBLE[], v::DOUBLE[])), 4) AS norm
FROM counted
"""


def _index_digest(chunks: DataFrame) -> DataFrame:
    counts = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return chunks.select("review_id", "chunk_ix", counts.alias("counts"), F.round("norm", 4).alias("norm"))


def _plain_reviews(documents: DataFrame) -> DataFrame:
    plain = F.trim(F.regexp_replace("text", _LETTERS, " "))
    return documents.select(F.col("doc_id").alias("review_id"), plain.alias("text"))


@query(_INDEX_SQL)
def index_words(spark: SparkSession, sf: str) -> DataFrame:
    """The whole corpus chunked and embedded; the SQL builds the same chunks and vectors."""
    return _index_digest(I.index_batch(_plain_reviews(table(spark, sf, "documents")), letter_counts))


@query(_INDEX_SQL)
def stream_index_words(spark: SparkSession, sf: str) -> DataFrame:
    """The same by stream into a table of chunks, read back."""
    folder = _run_folder(spark)
    sink = J.index_sink(f"{folder}/chunks", letter_counts)
    reviews = _plain_reviews(_stream(spark, sf, "documents")).withColumn("review_id", F.col("review_id").cast("string"))
    J.run_available(reviews, sink, f"{folder}/log").awaitTermination()
    chunks = J.current_chunks(spark, f"{folder}/chunks")
    return _index_digest(chunks).withColumn("review_id", F.col("review_id").cast("long"))
