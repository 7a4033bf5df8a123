"""Exact nearest-neighbour search.

One query vector is a literal: score, order, limit. For many query vectors each Arrow batch of the
table meets the whole query matrix in one product, and only the best `k` per query leave the task,
so pairs never exist as rows. A query set too large for that is cut into blocks that meet the table
shard by shard, again keeping `k` per query and shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from dishlens.functions.vectors import as_matrix, certainty
from dishlens.operators.dedup import top_per_key

# A query matrix travels to every task: at most this many cells (8 bytes each).
MAX_QUERY_CELLS = 8_000_000
BLOCK_QUERIES = 20_000
SHARD_ROWS = 50_000
PRODUCT_ROWS = 256

# Given the query matrix, a function of a matrix of rows in id order and k that yields (query rows, table rows, scores) of the
# best k pairs of each query. All vectors are of unit length.
Best = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]
Search = Callable[[np.ndarray], Callable[[np.ndarray, int], Best]]


def nearest(df: DataFrame, vector: str, query: Sequence[float], k: int, id_col: str) -> DataFrame:
    """The `k` rows closest to one vector, ties by id."""
    scored = df.withColumn("certainty", certainty(vector, query)).filter("certainty IS NOT NULL")
    return scored.orderBy(F.desc("certainty"), F.asc(id_col)).limit(k)


def _unit(matrix: np.ndarray) -> np.ndarray:
    lengths = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / lengths


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query row, table row) of the best k pairs per query; of equal scores the first rows stay.

    Exactly k leave however many copies of a vector there are, so rows must come in id order.
    """
    scores = np.where(np.isnan(scores), -np.inf, scores)
    keep = np.isfinite(scores)
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
        above, level = scores > floor, scores == floor
        room = k - above.sum(axis=1, keepdims=True)
        keep &= above | (level & (level.cumsum(axis=1) <= room))
    return np.nonzero(keep)


def every_pair(queries: np.ndarray) -> Callable[[np.ndarray, int], Best]:
    """All pairs, by one product per block of queries."""

    def search(rows: np.ndarray, k: int) -> Best:
        for start in range(0, len(queries), PRODUCT_ROWS):  # the product stays of one size
            scores = queries[start:start + PRODUCT_ROWS] @ rows.T
            at_query, at_row = _best(scores, k)
            yield at_query + start, at_row, scores[at_query, at_row]

    return search


def _not_beaten(kept: np.ndarray, at_query: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Which pairs, in order of their queries and at most k each, are as good as the k-th best a task has had; `kept` takes them in."""
    k = kept.shape[1]
    good = scores >= kept[at_query, 0]
    at_query, scores = at_query[good], scores[good]
    if len(at_query):
        asked, first, counts = np.unique(at_query, return_index=True, return_counts=True)
        more = np.full((len(asked), k), -np.inf)
        more[np.repeat(np.arange(len(asked)), counts), np.arange(len(at_query)) - np.repeat(first, counts)] = scores
        kept[asked] = np.sort(np.concatenate([kept[asked], more], axis=1), axis=1)[:, -k:]
    return good


def _ranked(pairs: DataFrame, query_id: str, id_col: str, k: int) -> DataFrame:
    order = [F.desc("certainty"), F.asc(id_col)]
    return top_per_key(pairs, [query_id], order, k, rank_col="rank")


def _width(rows: DataFrame, vector: str) -> int | None:
    """The one width of all vectors; None if there are none."""
    found = rows.agg(F.min(F.size(vector)).alias("low"), F.max(F.size(vector)).alias("high")).first()
    if found["low"] != found["high"]:
        raise ValueError(f"vectors of {found['low']} to {found['high']} numbers: pass dim")
    return found["low"]


def common_width(rows: DataFrame, vector: str) -> int | None:
    """The width most vectors have, of equally many the smaller; None if there are none."""
    sizes = rows.filter(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("width")).count()
    found = sizes.orderBy(F.desc("count"), "width").first()
    return found["width"] if found else None


def nearest_batch(
    table: DataFrame, vector: str, id_col: str,
    queries: DataFrame, query_vector: str, query_id: str,
    k: int, max_query_cells: int = MAX_QUERY_CELLS, dim: int | None = None, search: Search = every_pair,
) -> DataFrame:
    """(query_id, id, certainty, rank): the `k` closest rows for every query, exact unless `search` leaves pairs out.

    Vectors of another width than `dim` have no neighbours (`split_by_dimension` tells them apart);
    without `dim` all queries must be of one width.
    """
    head = queries.select(query_id, query_vector).filter(F.col(query_vector).isNotNull())
    dim = _width(head, query_vector) if dim is None else dim
    schema = (
        f"{query_id} {queries.schema[query_id].dataType.simpleString()}, "
        f"{id_col} {table.schema[id_col].dataType.simpleString()}, certainty double"
    )
    if dim is None:
        return table.sparkSession.createDataFrame([], schema + ", rank int")
    limit = max(1, max_query_cells // dim)
    head = head.filter(F.size(query_vector) == dim)
    sample = head.limit(limit + 1).toArrow()
    if not sample.num_rows:
        return table.sparkSession.createDataFrame([], schema + ", rank int")
    usable = table.filter(F.size(vector) == dim).select(id_col, vector)
    if sample.num_rows <= limit:
        pairs = _stream_pairs(usable, sample, dim, k, schema, search)
    else:
        pairs = _block_pairs(usable, vector, id_col, head, query_vector, query_id, dim, k, schema, search)
    return _ranked(pairs, query_id, id_col, k)


def _stream_pairs(table: DataFrame, queries: pa.Table, dim: int, k: int, schema: str, search: Search) -> DataFrame:
    spark = table.sparkSession
    ids = queries.column(0).combine_chunks()
    matrix = _unit(as_matrix(queries.column(1), dim))
    shared = spark.sparkContext.broadcast((ids, matrix))
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, query_matrix = shared.value
        best, kept = search(query_matrix), np.full((len(query_matrix), k), -np.inf)
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.sort_by(names[1])
            for at_query, at_row, scores in best(_unit(as_matrix(batch.column(1), dim)), k):
                good = _not_beaten(kept, at_query, scores)
                yield pa.RecordBatch.from_arrays(
                    [query_ids.take(pa.array(at_query[good])), batch.column(0).take(pa.array(at_row[good])),
                     pa.array(scores[good])],
                    names=names,
                )

    return table.mapInArrow(score, schema)


def _block_pairs(
    table: DataFrame, vector: str, id_col: str,
    queries: DataFrame, query_vector: str, query_id: str, dim: int, k: int, schema: str, search: Search = every_pair,
) -> DataFrame:
    """Blocks of queries against shards of the table; both are cut to a size one task can hold."""
    shards = max(1, -(-table.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    cut_table = table.withColumn("_shard", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int"))
    cut_table = cut_table.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cut_queries = queries.withColumn(
        "_block", F.pmod(F.xxhash64(query_id), F.lit(blocks)).cast("int")
    ).withColumn("_shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], id_col: [], "certainty": []})
        left = left.sort_values(id_col)
        rows = _unit(np.stack(left[vector].to_numpy()).astype("float64"))
        asked, found = _unit(np.stack(right[query_vector].to_numpy()).astype("float64")), []
        for at_query, at_row, scores in search(asked)(rows, k):
            found.append(pd.DataFrame({
                query_id: right[query_id].to_numpy()[at_query],
                id_col: left[id_col].to_numpy()[at_row],
                "certainty": scores,
            }))
        return pd.concat(found)

    keys = ["_block", "_shard"]
    return cut_table.groupBy(*keys).cogroup(cut_queries.groupBy(*keys)).applyInPandas(score, schema)


def nearest_match(
    items: DataFrame, vector: str, item_id: str,
    catalog: DataFrame, catalog_vector: str, catalog_id: str,
    max_cells: int = MAX_QUERY_CELLS, dim: int | None = None,
) -> DataFrame:
    """(item_id, catalog_id, certainty): the closest catalog row of every item, among vectors of width `dim`.

    A catalog that fits rides along to the tasks and no shuffle happens at all; beyond the bound the
    roles are swapped and the block search answers.
    """
    head = catalog.select(catalog_id, catalog_vector).filter(F.col(catalog_vector).isNotNull())
    dim = _width(head, catalog_vector) if dim is None else dim
    schema = (
        f"{item_id} {items.schema[item_id].dataType.simpleString()}, "
        f"{catalog_id} {catalog.schema[catalog_id].dataType.simpleString()}, certainty double"
    )
    if dim is None:
        return items.sparkSession.createDataFrame([], schema)
    limit = max(1, max_cells // dim)
    head = head.filter(F.size(catalog_vector) == dim)
    sample = head.orderBy(catalog_id).limit(limit + 1).toArrow()
    usable = items.filter(F.size(vector) == dim).select(item_id, vector)
    if sample.num_rows > limit:
        pairs = _block_pairs(head, catalog_vector, catalog_id, usable, vector, item_id, dim, 1, schema)
        return _ranked(pairs, item_id, catalog_id, 1).drop("rank")
    shared = items.sparkSession.sparkContext.broadcast(
        (sample.column(0).combine_chunks(), _unit(as_matrix(sample.column(1), dim)))
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = _unit(as_matrix(batch.column(1), dim)) @ matrix.T
            scores = np.where(np.isnan(scores), -np.inf, scores)
            at = scores.argmax(axis=1)  # catalog is in id order: the first of equals wins
            best = scores[np.arange(len(at)), at]
            good = np.isfinite(best)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), ids.take(pa.array(at[good])),
                 pa.array(best[good])],
                names=[item_id, catalog_id, "certainty"],
            )

    return usable.mapInArrow(match, schema)
