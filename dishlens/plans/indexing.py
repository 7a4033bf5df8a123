"""Corpus build: reviews joined with businesses, chunked, embedded, merged into the index."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from dishlens.constants import CHUNK_OVERLAP, CHUNK_RUNES
from dishlens.functions.keys import chunk_key
from dishlens.functions.text import chunks as cut
from dishlens.functions.vectors import norm
from dishlens.operators.filters import in_city
from dishlens.operators.joins import join_unique
from dishlens.operators.merge import merge_upsert, replace_children
from dishlens.operators.spread import spread_small

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]
EMBED_BATCH = 100
MAX_TRIES = 5
# Numbers of the vectors that a task keeps for texts that come again.
KEPT_CELLS = 4 << 20


def hashing_embedder(dim: int) -> EmbedFn:
    """Deterministic stand-in for a model: signed token hashes, unit length."""

    def embed(texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, text in enumerate(texts):
            for token in text.lower().split():
                code = zlib.crc32(token.encode("utf-8"))
                out[row, code % dim] += 1.0 if code & 0x10000 else -1.0
        lengths = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return (out / np.where(lengths > 0, lengths, 1.0)).astype("float32").tolist()

    return embed


def _patiently(embed: EmbedFn, texts: Sequence[str], pause: float) -> Sequence[Sequence[float]]:
    for attempt in range(MAX_TRIES):
        try:
            return embed(texts)
        except Exception:
            if attempt == MAX_TRIES - 1:
                raise
            time.sleep(pause * 2 ** (attempt + 1))
    raise AssertionError("unreachable")


def _embed_texts(
    columns: Iterator[pa.Array], embed: EmbedFn, batch: int, pause: float, cells: int = KEPT_CELLS,
) -> Iterator[pa.Array]:
    """A vector for every text; a text that a task meets again takes the vector it got, until `cells` numbers are kept."""
    kind = pa.list_(pa.float32())
    kept, place = pa.array([], kind), {}
    for column in columns:
        coded = pc.fill_null(column, "").dictionary_encode()
        texts = coded.dictionary.to_pylist()
        if len(kept.values) > cells:
            kept, place = pa.array([], kind), {}
        fresh = [text for text in texts if text not in place]
        found: list = []
        for start in range(0, len(fresh), batch):
            found.extend(_patiently(embed, fresh[start:start + batch], pause))
        place.update(zip(fresh, range(len(kept), len(kept) + len(found)), strict=True))
        if found:
            kept = pa.concat_arrays([kept, pa.array(found, kind)])
        yield kept.take(pa.array([place[text] for text in texts], pa.int64()).take(coded.indices))


def embed_column(
    df: DataFrame, text: str, embed: EmbedFn, out: str = "embedding",
    batch: int = EMBED_BATCH, pause: float = 1.0,
) -> DataFrame:
    """Add vectors of a text column. Rows stay in order and stream through in model batches of different texts; a
    failing call is retried with growing pauses before the task gives up."""

    @F.arrow_udf("array<float>")
    def vectors(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return _embed_texts(columns, embed, batch, pause)

    # Declared nondeterministic: the model must not be asked twice for the same text.
    return df.withColumn(out, vectors.asNondeterministic()(F.col(text)))


def joined_reviews(
    reviews: DataFrame, businesses: DataFrame, id_map: DataFrame | None = None, city: str = ""
) -> DataFrame:
    """Reviews with business facts ('' where the business is unknown) and, given a map of outside to
    inside ids (yelp_id, id), the inside id (NULL where unknown).

    A business may hold any share of the reviews: see `join_unique`.
    """
    facts = businesses.select(
        "business_id", F.col("name").alias("business_name"), "city", "state", "categories"
    )
    rows = join_unique(reviews, facts, ["business_id"], "left", ["review_id"]).fillna(
        "", subset=["business_name", "city", "state", "categories"]
    )
    if id_map is not None:
        inside = id_map.select(F.col("yelp_id").alias("business_id"), F.col("id").alias("business_uuid"))
        rows = join_unique(rows, inside, ["business_id"], "left", ["review_id"])
    return rows.filter(in_city(city))


def review_chunks(
    reviews: DataFrame, limit: int = CHUNK_RUNES, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """(chunk_id, review_id, chunk_ix, chunk_text)."""
    cut_reviews = spread_small(reviews.select("review_id", "text")).select(
        "review_id", cut("text", limit, overlap).alias("chunks")
    )
    return cut_reviews.select(
        "review_id", F.posexplode("chunks").alias("chunk_ix", "chunk_text")
    ).select(
        chunk_key(F.col("review_id").cast("string"), F.col("chunk_ix")).alias("chunk_id"),
        "review_id", "chunk_ix", "chunk_text",
    )


def index_batch(reviews: DataFrame, embed: EmbedFn, limit: int = CHUNK_RUNES,
                overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunk rows of a batch with vectors and their lengths, ready to be merged."""
    return embed_column(review_chunks(reviews, limit, overlap), "chunk_text", embed).withColumn(
        "norm", norm(F.col("embedding"))
    )


def whole_text_chunks(reviews: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One chunk, the whole text, for reviews that have a vector (review_id, embedding) but no chunks."""
    lone = reviews.join(vectors, "review_id").join(chunks.select("review_id"), "review_id", "left_anti")
    return lone.select(
        chunk_key(F.col("review_id").cast("string"), F.lit(0)).alias("chunk_id"),
        "review_id", F.lit(0).alias("chunk_ix"), F.col("text").alias("chunk_text"), "embedding",
    )


def review_vectors(chunks: DataFrame) -> DataFrame:
    """A review's own vector is that of its first chunk."""
    return chunks.filter("chunk_ix = 0").select("review_id", "embedding")


def upsert_reviews(base: DataFrame, batch: DataFrame) -> DataFrame:
    return merge_upsert(base, batch, ["review_id"])


def upsert_chunks(base: DataFrame, batch_reviews: DataFrame, fresh: DataFrame) -> DataFrame:
    """A review's chunks are replaced as a whole, so a shorter text leaves none behind."""
    return replace_children(base, batch_reviews, fresh, "review_id")
