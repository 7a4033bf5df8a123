"""Ranking, nearest neighbours, keyword score, catalog look-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dishlens.functions.text import bm25, tokens
from dishlens.functions.vectors import dimension_error
from dishlens.operators import knn
from dishlens.operators.counters import counted
from dishlens.operators.filters import SearchFilter
from dishlens.operators.spread import spread_small
from dishlens.plans import catalog as C, indexing as I, search as S
from dishlens.sources.archive import businesses, reviews as decode_reviews, reviews_of
from dishlens.suite.base import query, table

_QUERY_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_CORPUS = f"""
chunks AS (
  SELECT vec_id AS chunk_id, vec_id // 3 AS review_id, 'chunk ' || vec_id AS chunk_text,
         list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}) AS certainty
  FROM embeddings),
heads AS (SELECT vec_id // 3 AS review_id, min(label) AS biz FROM embeddings GROUP BY 1),
reviews AS (
  SELECT h.review_id, 'b' || h.biz AS business_id, 'Business ' || h.biz AS business_name,
         n_name AS city, r_name AS state, 'Food, ' || p_type AS categories,
         CAST(1 + h.review_id % 5 AS DOUBLE) AS stars, d.text
  FROM heads h
  LEFT JOIN nation ON n_nationkey = h.biz
  LEFT JOIN region ON r_regionkey = n_regionkey
  LEFT JOIN part ON p_partkey = h.biz
  LEFT JOIN documents d ON d.doc_id = h.review_id)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.expr("vec_id div 3").alias("review_id"),
        F.concat(F.lit("chunk "), "vec_id").alias("chunk_text"), "embedding",
    )


def _reviews(spark: SparkSession, sf: str) -> DataFrame:
    heads = table(spark, sf, "embeddings").groupBy(F.expr("vec_id div 3").alias("review_id")).agg(
        F.min("label").alias("biz")
    )
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    part, documents = table(spark, sf, "part"), table(spark, sf, "documents")
    return (
        heads.join(places, F.col("n_nationkey") == F.col("biz"), "left")
        .join(part, F.col("p_partkey") == F.col("biz"), "left")
        .join(documents, F.col("doc_id") == F.col("review_id"), "left")
        .select(
            "review_id", F.concat(F.lit("b"), "biz").alias("business_id"),
            F.concat(F.lit("Business "), "biz").alias("business_name"),
            F.col("n_name").alias("city"), F.col("r_name").alias("state"),
            F.concat(F.lit("Food, "), "p_type").alias("categories"),
            (F.lit(1) + F.col("review_id") % 5).cast("double").alias("stars"), "text",
        )
    )


def _query_vector(spark: SparkSession, sf: str) -> list[float]:
    row = table(spark, sf, "embeddings").filter("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({
        c: F.round(c, 6) for c in ("score", "stars", "certainty") if c in df.columns
    })


@query(f"""
WITH {_CORPUS},
best AS (SELECT review_id, max(certainty) AS certainty FROM chunks GROUP BY 1),
ranked AS (
  SELECT r.*, b.certainty,
         row_number() OVER (PARTITION BY business_id ORDER BY b.certainty DESC, r.review_id) AS rn
  FROM best b JOIN reviews r USING (review_id)),
grouped AS (
  SELECT business_id, max(business_name) AS name, max(city) AS city, max(state) AS state,
         max(categories) AS categories, avg(stars) AS stars, avg(certainty) AS score
  FROM ranked WHERE rn <= 5 GROUP BY 1)
SELECT business_id, name, city, state, categories, round(stars, 6) AS stars, round(score, 6) AS score
FROM grouped ORDER BY grouped.score DESC, business_id LIMIT 8
""")
def rank_businesses(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.rank_businesses(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 8))


@query(f"""
WITH {_CORPUS},
near AS (SELECT * FROM chunks ORDER BY certainty DESC, chunk_id LIMIT 80),
best AS (SELECT review_id, max(certainty) AS certainty FROM near GROUP BY 1),
joined AS (SELECT r.*, b.certainty FROM best b JOIN reviews r USING (review_id)),
stars AS (SELECT business_id, avg(stars) AS stars FROM joined WHERE stars > 0 GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY certainty DESC, review_id) AS rn FROM joined),
grouped AS (
  SELECT business_id, max(business_name) AS name, max(city) AS city, max(state) AS state,
         max(categories) AS categories, avg(certainty) AS score
  FROM ranked WHERE rn <= 5 GROUP BY 1)
SELECT g.business_id, name, city, state, categories, round(g.score, 6) AS score, round(s.stars, 6) AS stars
FROM grouped g JOIN stars s USING (business_id) ORDER BY g.score DESC, g.business_id LIMIT 4
""")
def rank_businesses_overfetch(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        S.rank_businesses_overfetch(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 4)
    )


@query(f"""
WITH {_CORPUS},
near AS (SELECT * FROM chunks ORDER BY certainty DESC, chunk_id LIMIT 50)
SELECT business_id, max(business_name) AS name, max(city) AS city, max(state) AS state,
       max(categories) AS categories, round(max(certainty), 6) AS score
FROM near JOIN reviews USING (review_id)
GROUP BY business_id ORDER BY max(certainty) DESC, business_id LIMIT 5
""")
def rank_businesses_max(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(
        S.rank_businesses_max(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 5)
    )


@query(f"""
WITH {_CORPUS},
best AS (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY certainty DESC, chunk_id) AS rn FROM chunks)
SELECT review_id, business_id, business_name, city, state, text, chunk_text, chunk_id,
       round(certainty, 6) AS certainty
FROM best JOIN reviews USING (review_id) WHERE rn = 1
ORDER BY best.certainty DESC, review_id LIMIT 20
""")
def rank_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.rank_reviews(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 20))


@query(f"""
WITH {_CORPUS},
best AS (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY certainty DESC, chunk_id) AS rn FROM chunks)
SELECT review_id, business_id, business_name, city, state, text, chunk_text, chunk_id,
       round(certainty, 6) AS certainty
FROM best JOIN reviews USING (review_id)
WHERE rn = 1 AND city ILIKE '%a%' AND state ILIKE 'a%'
ORDER BY best.certainty DESC, review_id LIMIT 20
""")
def filtered_search(spark: SparkSession, sf: str) -> DataFrame:
    where = SearchFilter(category="ignored for reviews", city="A", state="a%")
    return _rounded(
        S.rank_reviews(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 20, where)
    )


@query(f"""
WITH {_CORPUS},
best AS (SELECT review_id, max(certainty) AS certainty FROM chunks GROUP BY 1),
ranked AS (
  SELECT r.*, b.certainty,
         row_number() OVER (PARTITION BY business_id ORDER BY b.certainty DESC, r.review_id) AS rn
  FROM best b JOIN reviews r USING (review_id) WHERE contains(categories, 'O') AND state <> ''),
grouped AS (
  SELECT business_id, max(business_name) AS name, max(city) AS city, max(state) AS state,
         max(categories) AS categories, avg(stars) AS stars, avg(certainty) AS score
  FROM ranked WHERE rn <= 5 GROUP BY 1)
SELECT business_id, name, city, state, categories, round(stars, 6) AS stars, round(score, 6) AS score
FROM grouped ORDER BY grouped.score DESC, business_id LIMIT 8
""")
def filtered_businesses_exact(spark: SparkSession, sf: str) -> DataFrame:
    where = SearchFilter(category="O", match="exact")
    return _rounded(
        S.rank_businesses(_chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), 8, where)
    )


@query(f"""
WITH {_CORPUS}
SELECT review_id, business_id, text FROM reviews
WHERE review_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""")
def review_hydration(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "labels").filter("quality = 1").select(F.col("doc_id").alias("review_id"))
    return S.hydrate_reviews(_reviews(spark, sf), ids).select("review_id", "business_id", "text")


@query(f"""
WITH {_CORPUS} SELECT city, count(*) AS n FROM reviews GROUP BY 1 ORDER BY n DESC, city LIMIT 20
""")
def reviews_per_city(spark: SparkSession, sf: str) -> DataFrame:
    return S.reviews_per_city(_reviews(spark, sf))


@query(f"""
SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}), 6) AS certainty
FROM embeddings
ORDER BY list_cosine_similarity(embedding::DOUBLE[], {_QUERY_VECTOR}) DESC, vec_id LIMIT 25
""")
def nearest_topk(spark: SparkSession, sf: str) -> DataFrame:
    near = knn.nearest(table(spark, sf, "embeddings"), "embedding", _query_vector(spark, sf), 25, "vec_id")
    return _rounded(near.select("vec_id", "label", "certainty"))


_CENTROIDS = """
parts AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS p FROM embeddings),
centroids AS (
  SELECT label, list(m ORDER BY p) AS q FROM (SELECT label, p, avg(v) AS m FROM parts GROUP BY 1, 2) GROUP BY 1)"""


def _centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label: as many rows as there are labels, each of the vectors' width."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("p", "v"))
    means = cells.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    listed = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("p", "m"))).alias("cells"))
    return listed.select("label", F.transform("cells", lambda c: c["m"]).alias("q"))


@query(f"""
WITH {_CENTROIDS},
scored AS (
  SELECT c.label AS query_id, e.vec_id, list_cosine_similarity(e.embedding::DOUBLE[], c.q) AS s
  FROM centroids c, embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rn FROM scored)
SELECT query_id, vec_id, round(s, 6) AS certainty, CAST(rn AS INTEGER) AS rank FROM ranked WHERE rn <= 5
""")
def nearest_topk_batch(spark: SparkSession, sf: str) -> DataFrame:
    queries = _centroids(spark, sf).withColumnRenamed("label", "query_id")
    return _rounded(
        knn.nearest_batch(table(spark, sf, "embeddings"), "embedding", "vec_id", queries, "q", "query_id", 5)
    )


@query("""
WITH cut AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN embedding[1:63] ELSE embedding END AS v FROM embeddings)
SELECT CASE WHEN len(v) <> 64 THEN 'vector has dim ' || len(v) || ', expected 64' END AS reason, count(*) AS n
FROM cut GROUP BY 1
""")
def vector_guard(spark: SparkSession, sf: str) -> DataFrame:
    cut = table(spark, sf, "embeddings").select(
        F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("v")
    )
    return cut.groupBy(dimension_error("v", 64).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_TERMS = "the of and the entre"
_BM25 = """
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
scored AS (
  SELECT doc_id, len(t) AS n, {parts} AS total FROM toks)""".format(parts=" + ".join(
    f"{w} * (len(list_filter(t, lambda x: x = '{term}')) * 2.2 / (len(list_filter(t, lambda x: x = '{term}')) "
    f"+ 1.2 * (1 - 0.75 + 0.75 * len(t) / 100.0)))"
    for term, w in (("the", 2), ("of", 1), ("and", 1), ("entre", 1))
))


@query(f"""
WITH {_BM25}
SELECT doc_id, round(ln(2) * total / 5, 6) AS score FROM scored WHERE n > 0 AND total > 0
ORDER BY total DESC, doc_id LIMIT 50
""")
def bm25_search(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(S.keyword_rank(table(spark, sf, "documents"), "text", _TERMS, "doc_id", 50))


@query(f"""
WITH {_BM25}
SELECT doc_id, CASE WHEN n > 0 THEN round(ln(2) * total / 5, 6) ELSE 0.0 END AS score FROM scored
""")
def bm25_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.round(bm25(_TERMS, tokens("text")), 6).alias("score"))


@query(f"""
WITH {_CORPUS}, {_BM25},
near AS (SELECT * FROM chunks ORDER BY certainty DESC, chunk_id LIMIT 40),
best AS (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY certainty DESC, chunk_id) AS rn FROM near)
SELECT r.review_id, r.business_id, b.chunk_text,
       round(0.7 * b.certainty + (1 - 0.7) * CASE WHEN k.n > 0 THEN ln(2) * k.total / 5 ELSE 0 END, 6) AS score
FROM best b JOIN reviews r USING (review_id) JOIN scored k ON k.doc_id = r.review_id
WHERE rn = 1
""")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    found = S.hybrid_reviews(
        _chunks(spark, sf), _reviews(spark, sf), _query_vector(spark, sf), _TERMS, 40, 0.7
    )
    return _rounded(found).select("review_id", "business_id", "chunk_text", "score")


@query(f"""
WITH {_CENTROIDS},
near AS (
  SELECT e.vec_id AS item_id, c.label, list_cosine_similarity(e.embedding::DOUBLE[], c.q) AS s,
         row_number() OVER (PARTITION BY e.vec_id
                            ORDER BY list_cosine_similarity(e.embedding::DOUBLE[], c.q) DESC, c.label) AS rn
  FROM embeddings e, centroids c),
found AS (
  SELECT e.vec_id AS item_id, COALESCE(x.label, n.label) AS label,
         CASE WHEN x.label IS NOT NULL THEN 1.0::DOUBLE ELSE n.s END AS s
  FROM embeddings e LEFT JOIN centroids x ON x.label = e.vec_id
  JOIN near n ON n.item_id = e.vec_id AND n.rn = 1)
SELECT item_id, 'ing ' || label AS matched,
       CASE label % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END AS level,
       round(s, 6) AS certainty
FROM found
""")
def catalog_lookup(spark: SparkSession, sf: str) -> DataFrame:
    catalog = _centroids(spark, sf).select(
        F.concat(F.lit("ing "), "label").alias("ingredient"),
        F.expr("CASE label % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'moderate' ELSE 'low' END").alias("level"),
        F.array().cast("array<string>").alias("groups"), F.col("q").alias("embedding"),
    )
    items = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.concat(F.lit(" ING "), "vec_id").alias("ingredient"), "embedding"
    )
    return _rounded(C.lookup(items, catalog, vectors=True)).select("item_id", "matched", "level", "certainty")


_JOINED = """
reviews AS (SELECT doc_id AS review_id, source AS business_id, text FROM documents),
businesses AS (
  SELECT source AS business_id, upper(source) AS name, CASE WHEN source LIKE '%1%' THEN 'Las Vegas' ELSE 'Reno' END AS city,
         'NV' AS state, min(lang) AS categories
  FROM documents WHERE source NOT LIKE '%9' GROUP BY source)"""


def _source_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("review_id"), F.col("source").alias("business_id"), "text"
    )


def _source_businesses(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "documents").filter("source NOT LIKE '%9'")
        .groupBy(F.col("source").alias("business_id"))
        .agg(F.min("lang").alias("categories"))
        .select(
            "business_id", F.upper("business_id").alias("name"),
            F.expr("CASE WHEN business_id LIKE '%1%' THEN 'Las Vegas' ELSE 'Reno' END").alias("city"),
            F.lit("NV").alias("state"), "categories",
        )
    )


@query(f"""
WITH {_JOINED}
SELECT review_id, r.business_id, text, COALESCE(name, '') AS business_name, COALESCE(city, '') AS city,
       COALESCE(b.state, '') AS state, COALESCE(categories, '') AS categories,
       CASE WHEN name IS NOT NULL THEN 'id-' || name END AS business_uuid
FROM reviews r LEFT JOIN businesses b USING (business_id)
""")
def joined_reviews(spark: SparkSession, sf: str) -> DataFrame:
    businesses = _source_businesses(spark, sf)
    ids = businesses.select(F.col("business_id").alias("yelp_id"), F.concat(F.lit("id-"), "name").alias("id"))
    return I.joined_reviews(_source_reviews(spark, sf), businesses, ids)


@query(f"""
WITH {_JOINED}
SELECT review_id, business_id, city FROM reviews r LEFT JOIN businesses b USING (business_id)
WHERE lower(city) = 'las vegas'
""")
def city_reviews(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.joined_reviews(_source_reviews(spark, sf), _source_businesses(spark, sf), city="las VEGAS")
    return rows.select("review_id", "business_id", "city")


@query("SELECT doc_id AS review_id, source AS business_id, text FROM documents WHERE source = 'src7'")
def reviews_of_business(spark: SparkSession, sf: str) -> DataFrame:
    return reviews_of(_source_reviews(spark, sf), "src7")


@query("""
SELECT 'c-' || source AS camis, doc_id AS review_id, md5(text) AS text FROM documents WHERE source NOT LIKE '%9'
""")
def restaurant_reviews(spark: SparkSession, sf: str) -> DataFrame:
    shops = _source_businesses(spark, sf).select(
        F.col("business_id").alias("id"), F.concat(F.lit("c-"), "business_id").alias("camis")
    )
    joined = S.reviews_of_restaurants(_source_reviews(spark, sf), shops)
    return joined.select("camis", "review_id", F.md5("text").alias("text"))


@query("""
SELECT doc_id AS line_no, CAST(doc_id AS VARCHAR) AS review_id, '' AS user_id, source AS business_id,
  CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE doc_id % 5 + 0.5 END::DOUBLE AS stars, CAST(doc_id % 7 AS INTEGER) AS useful, text
FROM documents WHERE doc_id % 11 > 0 AND doc_id % 13 > 0
""")
def review_json_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with names in any case; every 11th is cut short, every 13th has a text for its stars."""
    line = F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("Review_ID"), F.col("source").alias("business_id"),
        F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 5 + 0.5).alias("STARS"),
        (F.col("doc_id") % 7).alias("useful"), F.col("text").alias("Text"), F.lit(1).alias("extra"),
    ))
    broken = F.when(F.col("doc_id") % 11 == 0, F.substring(line, 1, 30)).when(
        F.col("doc_id") % 13 == 0, F.lit('{"stars": "five"}')
    ).otherwise(line)
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), broken.alias("value"))
    decoded = decode_reviews(lines)
    return decoded.select(
        "line_no", "review_id", "user_id", "business_id", F.col("stars").cast("double").alias("stars"), "useful", "text"
    )


@query("""
SELECT CAST(o_custkey AS VARCHAR) AS business_id, arg_max(o_orderpriority, o_orderkey) AS name, '' AS categories FROM orders GROUP BY 1
""")
def business_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    line = F.to_json(F.struct(
        F.col("o_custkey").cast("string").alias("business_id"), F.col("o_orderpriority").alias("name"),
    ))
    lines = table(spark, sf, "orders").select(
        F.lit("a").alias("archive"), F.col("o_orderkey").alias("line_no"), line.alias("value")
    )
    return businesses(lines).select("business_id", "name", "categories")


@query("""
SELECT count(*) AS read, count(*) FILTER (WHERE n_chars > 3000) AS upserted, count(*) FILTER (WHERE n_chars <= 3000) AS failed FROM documents
""")
def import_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counters taken while the rows pass by on their way to a sink."""
    long = F.col("n_chars") > 3000
    rows, seen = counted(table(spark, sf, "documents"), "import", upserted=long, failed=~long)
    rows.write.format("noop").mode("overwrite").save()
    figures = seen.get
    return spark.range(1).select(*[
        F.lit(figures[k]).cast("bigint").alias(n) for n, k in (("read", "rows"), ("upserted", "upserted"), ("failed", "failed"))
    ])


@query()
def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    reviews = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), "text")
    return I.review_chunks(reviews)


# With single blanks as the only separators a chunk ends at the last blank that fits, which SQL can follow.
@query("""
WITH RECURSIVE plain AS (
  SELECT doc_id, trim(regexp_replace(text, '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM documents),
cut AS (
  SELECT doc_id, CAST(-1 AS INTEGER) AS ix, '' AS piece, t AS rest, FALSE AS done FROM plain
  UNION ALL
  SELECT doc_id, ix + 1,
    CASE WHEN length(rest) <= 800 THEN rest ELSE left(rest, 800 - instr(reverse(left(rest, 800)), ' ')) END,
    CASE WHEN length(rest) <= 800 THEN '' ELSE substr(rest, 802 - instr(reverse(left(rest, 800)), ' ')) END,
    length(rest) <= 800
  FROM cut WHERE NOT done)
SELECT doc_id, ix AS chunk_ix,
  md5(COALESCE(right(lag(piece) OVER (PARTITION BY doc_id ORDER BY ix), 100), '') || piece) AS chunk
FROM cut WHERE ix >= 0
""")
def chunk_words(spark: SparkSession, sf: str) -> DataFrame:
    plain = F.trim(F.regexp_replace("text", r"[^\p{L}\p{N}]+", " "))
    reviews = table(spark, sf, "documents").select(F.col("doc_id").alias("review_id"), plain.alias("text"))
    return I.review_chunks(reviews).select(F.col("review_id").alias("doc_id"), "chunk_ix", F.md5("chunk_text").alias("chunk"))


@query()
def index_corpus(spark: SparkSession, sf: str) -> DataFrame:
    reviews = spread_small(_source_reviews(spark, sf))
    joined = I.joined_reviews(reviews, _source_businesses(spark, sf))
    chunks = I.index_batch(joined, I.hashing_embedder(64))
    return chunks.join(joined.select("review_id", "business_name", "city"), "review_id").select(
        "chunk_id", "review_id", "chunk_ix", "business_name", "city",
        F.size("embedding").alias("dim"), F.round("norm", 4).alias("norm"),
    )
