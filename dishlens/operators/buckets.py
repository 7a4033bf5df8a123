"""Candidate search by random hyperplanes: several hash tables, look-up of buckets, exact scores of what they hold.

The signs of a vector's products with some random directions name its bucket in a table; near vectors share a bucket in
one of many tables. A query also probes the buckets across the planes it lies closest to. The answer is approximate:
`recall` measures it against the exact search, which stays the default. Finer buckets of a larger table lose neighbours, so the
number of bits is fitted: the largest whose recall suffices for a bounded choice of queries against all rows. Rows meet the queries
as in the exact search, batch by batch, where only pairs that share a bucket are scored: pairs never exist as rows, however
many copies of a vector there are, and only the best `k` of each query leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from dishlens.operators import knn

TABLES, PROBES, ROWS_PER_BUCKET = 24, 3, 64
# Queries on which the number of bits is fitted, and the recall they must reach.
FIT_QUERIES, FIT_RECALL = 100, 0.95
# Pairs of a query and a row that are looked at in one go, the share of them above which one product scores them all, and the
# numbers of vectors that are held otherwise to score them.
PAIRS, DENSE, GATHERED_CELLS = 1 << 20, 1 / 16, 4 << 20


def _planes(dim: int, tables: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).normal(size=(dim, tables * bits))


def _margins(matrix: np.ndarray, planes: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances from the planes, by table, what each bit is worth, and the vectors' own buckets: one per table."""
    margins = (matrix @ planes).reshape(len(matrix), tables, -1)
    powers = 1 << np.arange(margins.shape[2], dtype=np.int64)
    return margins, powers, ((margins > 0) * powers).sum(2)


def _probed(matrix: np.ndarray, planes: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """Buckets of queries: their own and `probes` more in each table, all different."""
    margins, powers, home = _margins(matrix, planes, tables)
    across = powers[np.argsort(np.abs(margins), 2)[:, :, :probes]]
    return np.concatenate([home[:, :, None], home[:, :, None] ^ across], axis=2)


def _sharing(probed: np.ndarray, home: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a query and a row share a bucket of some table. `home`: the rows' buckets, sorted by table; `order`: whose they are."""
    shared = np.zeros((len(probed), len(home)), bool)
    for table in range(home.shape[1]):
        low, high = (np.searchsorted(home[:, table], probed[:, table], side) for side in ("left", "right"))
        sizes = (high - low).ravel()
        before = sizes.cumsum() - sizes
        place = np.arange(sizes.sum()) + np.repeat(low.ravel() - before, sizes)
        shared[np.repeat(np.arange(len(probed)), (high - low).sum(1)), order[place, table]] = True
    return shared


def _scores(queries: np.ndarray, rows: np.ndarray, at_query: np.ndarray, at_row: np.ndarray) -> np.ndarray:
    step = max(1, GATHERED_CELLS // queries.shape[1])
    parts = [slice(start, start + step) for start in range(0, len(at_query), step)]
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", queries[at_query[p]], rows[at_row[p]]) for p in parts)])


def _search(dim: int, tables: int, bits: int, probes: int, seed: int) -> knn.Search:
    """Pairs that share a bucket, for `knn.nearest_batch`. A pair's score is summed up in one order, so copies are level."""

    def prepared(queries: np.ndarray) -> Callable[[np.ndarray, int], knn.Best]:
        planes = _planes(dim, tables, bits, seed)
        probed = _probed(queries, planes, tables, probes)

        def search(rows: np.ndarray, k: int) -> knn.Best:
            home = _margins(rows, planes, tables)[2]
            order = home.argsort(0, kind="stable")
            home = np.take_along_axis(home, order, 0)
            step = max(1, PAIRS // len(rows))
            for start in range(0, len(queries), step):
                part = queries[start:start + step]
                shared = _sharing(probed[start:start + step], home, order)
                if shared.mean() > DENSE:
                    at_query, at_row = knn._best(np.where(shared, part @ rows.T, -np.inf), k)
                    scores = _scores(part, rows, at_query, at_row)
                else:
                    at_query, at_row = np.nonzero(shared)
                    scores = _scores(part, rows, at_query, at_row)
                    best = np.lexsort((at_row, -scores, at_query))  # no number comes last
                    at_query, at_row, scores = at_query[best], at_row[best], scores[best]
                    rank = np.arange(len(best)) - np.searchsorted(at_query, at_query)
                    keep = (rank < k) & np.isfinite(scores)
                    at_query, at_row, scores = at_query[keep], at_row[keep], scores[keep]
                yield at_query + start, at_row, scores

        return search

    return prepared


def nearest_batch_buckets(
    table: DataFrame, vector: str, id_col: str, queries: DataFrame, query_vector: str, query_id: str, k: int, dim: int,
    tables: int = TABLES, bits: int | None = None, probes: int = PROBES, seed: int = 7,
) -> DataFrame:
    """(query_id, id, certainty, rank): about the `k` closest rows for every query; see `recall`.

    Vectors of another width than `dim`, null, zero and not finite ones have no neighbours. `bits` is fitted to at most `FIT_QUERIES`
    queries unless given; where no number of bits is good enough, and for queries whose buckets hold fewer than `k` rows, the exact search answers.
    """
    usable = table.filter(F.size(vector) == dim).select(id_col, F.col(vector).alias("_v"))
    asked = queries.filter(F.size(query_vector) == dim).select(query_id, F.col(query_vector).alias("_q"))
    if bits is None:
        bits = _fitted_bits(usable, id_col, asked, query_id, k, dim, tables, probes, seed)
    if not bits:
        return knn.nearest_batch(usable, "_v", id_col, asked, "_q", query_id, k, dim=dim)
    found = _from_buckets(usable, id_col, asked, query_id, k, dim, tables, bits, probes, seed).persist()
    full = found.groupBy(query_id).count().filter(F.col("count") >= k)
    short = asked.join(full, query_id, "left_anti")
    filled = knn.nearest_batch(usable, "_v", id_col, short, "_q", query_id, k, dim=dim)
    return found.join(full, query_id, "left_semi").unionByName(filled)


def _fitted_bits(
    usable: DataFrame, id_col: str, asked: DataFrame, query_id: str, k: int, dim: int, tables: int, probes: int, seed: int
) -> int:
    """The most bits, `ROWS_PER_BUCKET` rows a bucket at the least, that reach `FIT_RECALL`; 0 if none do."""
    rows = usable.count()
    some = asked.orderBy(F.xxhash64(query_id), query_id).limit(FIT_QUERIES).persist()
    exact = knn.nearest_batch(usable, "_v", id_col, some, "_q", query_id, k, dim=dim).persist()
    most = min(40, max(1, round(math.log2(max(rows, 1) / ROWS_PER_BUCKET)))) if rows else 0
    reached = 0
    for bits in range(most, 0, -1):
        found = _from_buckets(usable, id_col, some, query_id, k, dim, tables, bits, probes, seed)
        if recall(found, exact, query_id, id_col).first()["recall"] >= FIT_RECALL:
            reached = bits
            break
    exact.unpersist()
    some.unpersist()
    return reached


def _from_buckets(
    usable: DataFrame, id_col: str, asked: DataFrame, query_id: str, k: int, dim: int, tables: int, bits: int, probes: int, seed: int
) -> DataFrame:
    probes = min(probes, bits)
    cells = knn.MAX_QUERY_CELLS * dim // (dim + tables * (1 + probes))  # the queries' buckets take room beside them
    return knn.nearest_batch(
        usable, "_v", id_col, asked, "_q", query_id, k, cells, dim, _search(dim, tables, bits, probes, seed)
    )


def recall(found: DataFrame, exact: DataFrame, query_id: str, id_col: str) -> DataFrame:
    """One row: `pairs` of a query and one of its true neighbours, how many were `found`, and the `recall`."""
    hit = found.select(query_id, id_col, F.lit(1).alias("_hit"))
    counts = exact.select(query_id, id_col).join(hit, [query_id, id_col], "left").agg(
        F.count(F.lit(1)).alias("pairs"), F.count("_hit").alias("found")
    )
    return counts.withColumn("recall", F.col("found") / F.greatest(F.col("pairs"), F.lit(1)))
