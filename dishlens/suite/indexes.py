"""Searches through stored indexes and merges into bucketed tables, against the SQL of the plain form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.operators import bucketed, buckets, codes, knn, merge, trigrams
from dishlens.plans import catalog as C, keywords
from dishlens.suite.base import ORACLES, query, table
from dishlens.suite.restaurants import _base, _batch
from dishlens.suite.search import _CENTROIDS, _TERMS, _centroids, _query_vector, _rounded
from dishlens.suite.streams import _run_folder


@query(ORACLES["nearest_topk"])
def nearest_topk_codes(spark: SparkSession, sf: str) -> DataFrame:
    """One byte a number is scanned; only rows in question are scored exactly."""
    root, rows = _run_folder(spark), table(spark, sf, "embeddings")
    codes.store(rows, "embedding", "vec_id", 64, root)
    near, _ = codes.nearest_stored(spark, root, rows.schema, "embedding", _query_vector(spark, sf), 25, "vec_id")
    return _rounded(near.select("vec_id", "label", "certainty"))


@query("""
WITH asked AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, true AS recall_reached FROM asked, range(1, 11) r(rank)
""")
def nearest_topk_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Ten neighbours of every twentieth vector among all, with the recall of the whole answer against exact search."""
    rows = table(spark, sf, "embeddings")
    asked = rows.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    found = buckets.nearest_batch_buckets(rows, "embedding", "vec_id", asked, "q", "query_id", 10, 64)
    exact = knn.nearest_batch(rows, "embedding", "vec_id", asked, "q", "query_id", 10, dim=64)
    reached = buckets.recall(found, exact, "query_id", "vec_id").select((F.col("recall") >= 0.9).alias("recall_reached"))
    return found.select("query_id", "rank", reached.scalar().alias("recall_reached"))


@query(ORACLES["bm25_search"])
def bm25_search_index(spark: SparkSession, sf: str) -> DataFrame:
    root = _run_folder(spark)
    keywords.write_postings(table(spark, sf, "documents"), "text", "doc_id", root, block_documents=64)
    return _rounded(keywords.keyword_search(spark, root, _TERMS, "doc_id", 50))


_PATTERNS = ["%REEN%", "%a_d%e %", "lemon%", "%o%", "%zzz%", "s__n%h%"]


@query(" UNION ALL ".join(
    f"SELECT '{p}' AS pattern, p_partkey, p_name FROM part WHERE p_name ILIKE '{p}'" for p in _PATTERNS
))
def name_filter_index(spark: SparkSession, sf: str) -> DataFrame:
    """Substrings, wildcards inside, anchors, and patterns without three characters in a row."""
    root, parts = _run_folder(spark), table(spark, sf, "part")
    trigrams.write_trigrams(parts, "p_name", "p_partkey", root)
    out = None
    for pattern in _PATTERNS:
        rows = trigrams.matching(spark, parts, "p_name", "p_partkey", root, pattern)
        rows = rows.select(F.lit(pattern).alias("pattern"), "p_partkey", "p_name")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""
WITH {_CENTROIDS},
near AS (
  SELECT e.vec_id AS item_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.q) AS s,
         row_number() OVER (PARTITION BY e.vec_id
                            ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], c.q) DESC, c.label) AS rn
  FROM embeddings e, centroids c WHERE c.label % 4 > 0 AND e.vec_id % 7 > 0),
found AS (
  SELECT e.vec_id AS item_id, COALESCE(x.label, n.label) AS label,
         CASE WHEN x.label IS NOT NULL THEN 1.0::DOUBLE ELSE n.s END AS s
  FROM embeddings e LEFT JOIN centroids x ON x.label = e.vec_id
  LEFT JOIN near n ON n.item_id = e.vec_id AND n.rn = 1)
SELECT item_id, 'ing ' || label AS matched, round(s, 6) AS certainty FROM found
""")
def catalog_lookup_widths(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth entry and every seventh item has a vector of another width: matched by name or not at all."""
    cut = lambda c, key, n: F.when(key % n == 0, F.slice(c, 1, 63)).otherwise(F.col(c)).alias("embedding")
    catalog = _centroids(spark, sf).select(
        F.concat(F.lit("ing "), "label").alias("ingredient"), F.lit("low").alias("level"),
        F.array().cast("array<string>").alias("groups"), cut("q", F.col("label"), 4),
    )
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit(" ING "), "vec_id").alias("ingredient"), cut("embedding", F.col("vec_id"), 7)
    )
    return _rounded(C.lookup(items, catalog, vectors=True)).select("item_id", "matched", "certainty")


@query(ORACLES["merge_overwrite"])
def merge_overwrite_bucketed(spark: SparkSession, sf: str) -> DataFrame:
    """The base lies in buckets; merged twice, as a job that runs again does."""
    columns = ["camis", "dba", "address", "phone"]
    table_ = bucketed.write_bucketed(_base(spark, sf).select(columns), f"merged_{uuid.uuid4().hex}", ["camis"], 8)
    for _ in range(2):
        table_ = bucketed.merge_bucketed(
            spark, table_, _batch(spark, sf).select(columns), ["camis"], lambda old, new: merge.merge_upsert(old, new, ["camis"])
        )
    return spark.table(table_)
