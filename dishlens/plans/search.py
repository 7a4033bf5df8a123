"""Semantic ranking of businesses and reviews.

Chunks are scored where they are read, so vectors never enter a shuffle: what moves is one number
per review. Texts join back only for the rows of the final answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.constants import REVIEWS_PER_BUSINESS
from dishlens.functions.text import blend, bm25, tokens
from dishlens.functions.vectors import certainty
from dishlens.operators.dedup import top_per_key
from dishlens.operators.filters import SearchFilter
from dishlens.operators.joins import join_unique
from dishlens.operators.spread import spread_small

# Rows of an answer, with a chunk of bounded length each, that may be sent to every task.
MAX_ANSWER = 5_000

_PLACE = ("business_name", "city", "state", "categories")


def score_chunks(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    norm = "norm" if "norm" in chunks.columns else None
    return chunks.select(
        "review_id", "chunk_id", certainty("embedding", query, stored_norm=norm).alias("certainty")
    )


def _top_reviews_per_business(best: DataFrame, n: int) -> DataFrame:
    return top_per_key(best, ["business_id"], [F.desc("certainty"), F.asc("review_id")], n)


def _ranked_businesses(grouped: DataFrame, limit: int) -> DataFrame:
    return grouped.orderBy(F.desc("score"), F.asc("business_id")).limit(limit)


def rank_businesses(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], limit: int,
    where: SearchFilter = SearchFilter(), per_business: int = REVIEWS_PER_BUSINESS,
) -> DataFrame:
    """Businesses by the mean certainty of their best reviews, each review by its best chunk."""
    best = score_chunks(chunks, query).groupBy("review_id").agg(F.max("certainty").alias("certainty"))
    facts = reviews.filter(where.for_businesses()).select("review_id", "business_id", "stars", *_PLACE)
    sampled = _top_reviews_per_business(best.join(facts, "review_id"), per_business)
    grouped = sampled.groupBy("business_id").agg(
        F.max("business_name").alias("name"),
        *[F.max(c).alias(c) for c in _PLACE[1:]],
        F.avg("stars").alias("stars"),
        F.avg("certainty").alias("score"),
    )
    return _ranked_businesses(grouped, limit)


def nearest_chunks(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], limit: int, condition: Column | None
) -> DataFrame:
    """The nearest chunks with their reviews' facts; a condition applies before the cut."""
    scored = score_chunks(chunks, query)
    facts = reviews.select("review_id", "business_id", "stars", *_PLACE)
    order = [F.desc_nulls_last("certainty"), F.asc("chunk_id")]
    if condition is None:
        return scored.orderBy(*order).limit(limit).join(facts, "review_id", "left")
    kept = reviews.filter(condition).select("review_id")
    near = scored.join(kept, "review_id", "left_semi").orderBy(*order).limit(limit)
    return near.join(facts, "review_id", "left")


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def rank_businesses_overfetch(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], limit: int,
    where: SearchFilter | None = None, per_business: int = REVIEWS_PER_BUSINESS, factor: int = 20,
) -> DataFrame:
    """Ranking over the `limit * factor` nearest chunks only. Stars average over every sampled
    review that has some; a chunk without score counts as 1."""
    near = nearest_chunks(
        chunks, reviews, query, limit * factor, where.for_businesses() if where else None
    ).filter(_filled("business_id") & _filled("review_id"))
    best = (
        near.withColumn("certainty", F.coalesce("certainty", F.lit(1.0)))
        .groupBy("business_id", "review_id")
        .agg(F.max("certainty").alias("certainty"), F.max("stars").alias("stars"),
             *[F.max(c).alias(c) for c in _PLACE])
    )
    stars = best.groupBy("business_id").agg(
        F.coalesce(F.avg(F.when(F.col("stars") > 0, F.col("stars"))), F.lit(0.0)).alias("stars")
    )
    grouped = _top_reviews_per_business(best, per_business).groupBy("business_id").agg(
        F.max("business_name").alias("name"),
        *[F.max(c).alias(c) for c in _PLACE[1:]],
        F.avg("certainty").alias("score"),
    )
    return _ranked_businesses(grouped.join(stars, "business_id"), limit)


def rank_businesses_max(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], limit: int,
    where: SearchFilter | None = None, factor: int = 10,
) -> DataFrame:
    """Businesses by their single nearest chunk among the `limit * factor` nearest."""
    near = nearest_chunks(
        chunks, reviews, query, limit * factor, where.for_businesses() if where else None
    ).filter(_filled("business_id"))
    facts = F.struct("certainty", "chunk_id", *_PLACE)
    best = near.groupBy("business_id").agg(F.max(facts).alias("best"))
    grouped = best.select(
        "business_id", F.col("best.business_name").alias("name"),
        *[F.col(f"best.{c}").alias(c) for c in _PLACE[1:]], F.col("best.certainty").alias("score"),
    )
    return _ranked_businesses(grouped, limit)


def best_chunks(chunks: DataFrame, query: Sequence[float]) -> DataFrame:
    """(review_id, chunk_id, certainty) of the best chunk of every review."""
    scored = score_chunks(chunks, query)
    return top_per_key(scored, ["review_id"], [F.desc_nulls_last("certainty"), F.asc("chunk_id")])


def rank_reviews(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], limit: int,
    where: SearchFilter = SearchFilter(),
) -> DataFrame:
    """Reviews by their best chunk, with text and the chunk that matched."""
    kept = reviews.filter(where.for_reviews()).select("review_id")
    top = (
        best_chunks(chunks, query).join(kept, "review_id", "left_semi")
        .orderBy(F.desc_nulls_last("certainty"), F.asc("review_id")).limit(limit)
    )
    return _with_texts(top, chunks, reviews, limit).orderBy(
        F.desc_nulls_last("certainty"), F.asc("review_id")
    )


def _with_texts(top: DataFrame, chunks: DataFrame, reviews: DataFrame, limit: int) -> DataFrame:
    """Chunk and review texts of an answer of at most `limit` rows.

    Up to MAX_ANSWER rows it is sent to the tasks that read the texts (a chunk's length is bounded); a larger
    answer is joined as Spark sees fit.
    """
    send = F.broadcast if limit <= MAX_ANSWER else lambda df: df
    texts = reviews.select("review_id", "business_id", "business_name", "city", "state", "text")
    parts = chunks.select("chunk_id", "chunk_text")
    found = parts.join(send(top), "chunk_id")
    return texts.join(send(found), "review_id")


def hybrid_reviews(
    chunks: DataFrame, reviews: DataFrame, query: Sequence[float], query_text: str, limit: int,
    alpha: float, where: SearchFilter = SearchFilter(match="exact"),
) -> DataFrame:
    """The `limit` nearest chunks, one row per review, re-ranked by a vector and keyword blend."""
    kept = reviews.filter(where.for_reviews()).select("review_id")
    order = [F.desc_nulls_last("certainty"), F.asc("chunk_id")]
    near = score_chunks(chunks, query).join(kept, "review_id", "left_semi").orderBy(*order).limit(limit)
    top = top_per_key(near, ["review_id"], order)
    scored = _with_texts(top, chunks, reviews, limit).withColumn(
        "score", blend(F.col("certainty"), bm25(query_text, tokens("text")), alpha)
    )
    return scored.orderBy(F.desc("score"), F.asc("review_id"))


def keyword_rank(docs: DataFrame, text: str, query_text: str, id_col: str, limit: int) -> DataFrame:
    """Texts by keyword score."""
    scored = spread_small(docs.select(id_col, text)).select(
        id_col, bm25(query_text, tokens(text)).alias("score")
    )
    # Filtering after the cut gives the same rows and scores every text once.
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(limit).filter("score > 0")


def hydrate_reviews(reviews: DataFrame, ids: DataFrame) -> DataFrame:
    return reviews.join(ids.select("review_id"), "review_id", "left_semi")


def reviews_of_restaurants(reviews: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Reviews with the public number of their restaurant."""
    keys = restaurants.select(F.col("id").alias("business_id"), "camis")
    return join_unique(reviews, keys, ["business_id"], "inner", ["review_id"])


def reviews_per_city(reviews: DataFrame, limit: int = 20) -> DataFrame:
    return (
        reviews.groupBy("city").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("city")).limit(limit)
    )
