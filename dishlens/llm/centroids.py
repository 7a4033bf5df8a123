"""k-means with exact integer arithmetic and geometric drift tightening.

Vectors stand in blocks, one row each, beside what is known of them: the cluster, an upper bound of the distance to
its centroid and a lower bound of the distance to all others. When centroids move, the upper bound grows by the move of
the own centroid. The lower bound shrinks by less than the moves of the others: all vectors of a cluster lie in a
sphere around its old centroid, and how much nearer a centroid that went from p to q can come to any point of that
sphere is a question in the plane through p, q and the centre (`loosened`). Only vectors whose bounds then cross are
ambiguous; their distances are computed exactly, in whole numbers, so assignments equal those of a full scan.

A round is one pass over the blocks, written to the shared folder in turns of two folders, and one small
aggregation of the blocks' sums; no vector is shuffled, and what reaches the driver are k centroids. A lost task
is computed again from the round before.

Rows: vectors that are null, of another width or hold nulls or non-finite entries are left out; components beyond
+-2^27 (of 1024ths: +-131072.0) stand for that bound, as distances couldn't be longs else. Equal vectors get equal clusters;
repeated ids and null ids stay rows of their own, null ids are no first centroids unless too few others exist. Fewer
vectors than k give as many clusters; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dishlens.llm.common import folder

#: Vectors of a block at most; the bound of components.
BLOCK, LIMIT = 4096, 1 << 27
_SLACK = 1e-9  # far above the rounding of square roots and sines, far below 1
_STATE = (
    "ids binary, missing binary, x binary, cluster binary, upper binary, lower binary, "
    "sums array<long>, reach array<long>, inertia array<decimal(38,0)>, scanned long"
)


def kept(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, x): usable vectors, as doubles."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width)).filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")
    )


def whole(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * 1024), -LIMIT, LIMIT).astype(np.int64)


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors whose seeded id has the smallest SHA-256, in that order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.select(digest.alias("digest"), "x").orderBy(F.asc_nulls_last("digest"), "x").limit(k).collect()
    return np.array([whole(np.array(r["x"])) for r in found], np.int64)


@dataclass(frozen=True)
class Move:
    """What a round needs: the centroids, and from the second round on how far bounds have to give way."""

    centroids: np.ndarray
    grown: np.ndarray | None = None  # per cluster: added to upper bounds
    drop: np.ndarray | None = None  # per cluster: taken from lower bounds


def loosened(centre: np.ndarray, radius: float, p: np.ndarray, q: np.ndarray) -> float:
    """By how much at most |x - q| is below |x - p| for any x of a sphere.

    With m the middle of p and q, d their distance and t the angle between x - m and q - p,
    |x-p| - |x-q| = (|x-p|^2 - |x-q|^2) / (|x-p| + |x-q|) <= 2 d |x-m| cos t / (2 |x-m|) = d cos t where cos t > 0,
    and it is not above 0 elsewhere. Seen from m, the sphere fills the angles within asin(radius / |centre - m|)
    of its centre's; the plane through p, q and the centre holds the least of them.
    """
    way = q.astype(float) - p
    d = float(np.sqrt((way**2).sum()))
    if d == 0:
        return 0.0
    out = centre - (p + q.astype(float)) / 2
    far = float(np.sqrt((out**2).sum()))
    if radius >= far:
        return d * (1 + _SLACK)
    angle = math.acos(max(-1.0, min(1.0, float(out @ way) / (far * d)))) - math.asin(radius / far)
    least = max(0.0, angle)
    return 0.0 if least > math.pi / 2 + _SLACK else d * (max(0.0, math.cos(least)) + _SLACK)


def moved(old: np.ndarray, new: np.ndarray, reach: np.ndarray, tight: bool = True) -> Move:
    """Bounds' changes from the old to the new centroids; `reach` are the spheres' radii. Not tight: full drift."""
    k = len(old)
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1)) * (1 + _SLACK)
    drop = np.zeros(k)
    for a in range(k):
        others = [j for j in range(k) if j != a]
        lost = [loosened(old[a].astype(float), float(reach[a]), old[j], new[j]) if tight else drift[j] for j in others]
        drop[a] = max(lost, default=0.0)
    return Move(new, drift, drop)


def _exact(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = x - centroid
    return np.einsum("ij,ij->i", away, away)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, move: Move) -> int:
    """Bring clusters and bounds of a block up to date, in place; returns how many vectors were scanned."""
    c, n = move.centroids, len(x)
    if move.grown is None:
        doubt = np.arange(n)
    else:
        upper += move.grown[cluster]
        upper *= 1 + _SLACK
        lower -= move.drop[cluster]
        lower *= np.where(lower > 0, 1 - _SLACK, 1 + _SLACK)
        doubt = np.flatnonzero(upper >= lower)
        for a in np.unique(cluster[doubt]):  # a fresh distance to the own centroid settles many
            own = doubt[cluster[doubt] == a]
            upper[own] = np.sqrt(_exact(x[own], c[a]).astype(float)) * (1 + _SLACK)
        doubt = doubt[upper[doubt] >= lower[doubt]]
    if len(doubt):
        away = np.stack([_exact(x[doubt], centroid) for centroid in c], 1)
        best = away.argmin(1)  # the first of equal ones: the smaller number
        rows = np.arange(len(doubt))
        cluster[doubt], upper[doubt] = best, np.sqrt(away[rows, best].astype(float)) * (1 + _SLACK)
        away[rows, best] = np.iinfo(np.int64).max
        second = away.min(1).astype(float) if len(c) > 1 else np.full(len(doubt), np.inf)
        lower[doubt] = np.sqrt(second) * (1 - _SLACK)
    return len(doubt)


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at: at + BLOCK]
                x = whole(np.stack(part["x"].to_list()).reshape(len(part), width)).astype("<i4")
                yield pd.DataFrame({
                    "ids": [part["id"].to_numpy("<i8").tobytes()], "missing": [part["missing"].to_numpy(bool).tobytes()],
                    "x": [x.tobytes()],
                })

    numbered = rows.select(
        F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("missing"), "x"
    )
    return numbered.mapInPandas(pack, "ids binary, missing binary, x binary")


def _round(blocks: DataFrame, width: int, move: Move, first: bool, last: bool) -> DataFrame:
    k = len(move.centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.x, "<i4").reshape(-1, width).astype(np.int64)
                n = len(x)
                if first:
                    cluster, upper, lower = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                else:
                    cluster = np.frombuffer(row.cluster, "<i4").astype(np.int64)
                    upper, lower = np.frombuffer(row.upper, "<f8").copy(), np.frombuffer(row.lower, "<f8").copy()
                scanned = assign(x, cluster, upper, lower, move)
                sums, reach, inertia = np.zeros((k, width + 1), np.int64), np.zeros(k), [0] * k
                for a in range(k):
                    sums[a, :width] = x[cluster == a].sum(0)
                sums[:, width] = np.bincount(cluster, minlength=k)
                np.maximum.at(reach, cluster, upper)
                if last:
                    for a in range(k):
                        inertia[a] = sum(_exact(x[cluster == a], move.centroids[a]).tolist())
                yield pd.DataFrame({
                    "ids": [row.ids], "missing": [row.missing], "x": [row.x], "cluster": [cluster.astype("<i4").tobytes()],
                    "upper": [upper.tobytes()], "lower": [lower.tobytes()], "sums": [sums.ravel()],
                    "reach": [np.ceil(reach).astype(np.int64)],
                    "inertia": [[decimal.Decimal(i) for i in inertia]], "scanned": [scanned],
                })

    return blocks.mapInPandas(run, _STATE)


def _gathered(state: DataFrame, column: str, how: Column) -> list:
    """One value for each place of the blocks' arrays; the arrays have a fixed length."""
    rows = state.select(F.posexplode(column).alias("at", "v")).groupBy("at").agg(how.alias("v"))
    return [r["v"] for r in sorted(rows.collect())]


class Rounds:
    """Passes over the blocks; each is written into the folder that the round before didn't use."""

    def __init__(self, rows: DataFrame, width: int, tight: bool = True):
        self.spark: SparkSession = rows.sparkSession
        self.width, self.tight = width, tight
        base = folder(self.spark, "centroids")
        self.paths, self.turn = [f"{base}/0", f"{base}/1"], 0
        self.state, self.scanned = _blocks(rows, width), []

    def pass_over(self, move: Move, last: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(sums with counts in the last column, radii) after all vectors met the centroids."""
        path = self.paths[self.turn]
        _round(self.state, self.width, move, not self.scanned, last).write.mode("overwrite").parquet(path)
        self.turn = 1 - self.turn
        self.state = self.spark.read.schema(_STATE).parquet(path)
        sums = np.array(_gathered(self.state, "sums", F.sum("v")), dtype=object).reshape(-1, self.width + 1)
        reach = np.array(_gathered(self.state, "reach", F.max("v")), float)
        self.scanned.append(self.state.agg(F.sum("scanned")).first()[0])
        return sums, reach


def means(old: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Exact floors of sum / count; clusters without vectors stay where they are."""
    new = old.copy()
    for a, row in enumerate(sums):
        if row[-1]:
            new[a] = [int(s) // int(row[-1]) for s in row[:-1]]
    return new


def clustered(
    vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3, tight: bool = True,
    scanned: list[int] | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    `scanned`, where given, gets the number of vectors that each pass had to scan.
    """
    rows = kept(vectors, width)
    centroids = first_centroids(rows, k, seed)
    schema = (
        "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    if not len(centroids):
        return rows.sparkSession.createDataFrame([], schema)
    run = Rounds(rows, width, tight)
    move = Move(centroids)
    for _ in range(rounds):
        sums, reach = run.pass_over(move)
        centroids = means(move.centroids, sums)
        move = moved(move.centroids, centroids, reach, tight)
    run.pass_over(move, last=True)
    if scanned is not None:
        scanned += run.scanned
    inertia = [int(i) for i in _gathered(run.state, "inertia", F.sum("v"))]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    total = sum(inertia)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = np.frombuffer(row.x, "<i4").reshape(-1, width).astype(np.int64)
                cluster = np.frombuffer(row.cluster, "<i4")
                distance = np.zeros(len(x), np.int64)
                for a in np.unique(cluster):
                    distance[cluster == a] = _exact(x[cluster == a], centroids[a])
                yield pd.DataFrame({
                    "vec_id": pd.arrays.IntegerArray(np.frombuffer(row.ids, "<i8").copy(), np.frombuffer(row.missing, bool).copy()),
                    "cluster": cluster,
                    "distance": distance, "cluster_inertia": [inertia[a] for a in cluster], "inertia": total,
                    "centroid_sha256": [digests[a] for a in cluster],
                })

    return run.state.select("ids", "missing", "x", "cluster").mapInPandas(unpack, schema)


def sql(k: int = 8, rounds: int = 10, width: int = 64, seed: int = 3) -> str:
    """The same in SQL: one pair of subqueries a round, every vector against every centroid."""
    near = (
        "{name} AS MATERIALIZED (SELECT r, min(vec_id) AS vec_id, arg_min(k, d * {k} + k) AS k, min(d) AS d FROM ("
        "SELECT v.r, v.vec_id, c.k, CAST(list_sum(list_transform(range(1, {w} + 1), lambda i: (v.x[i] - c.c[i]) * (v.x[i] - c.c[i]))) AS BIGINT) AS d "
        "FROM kept v, {of} c) GROUP BY r)"
    )
    step = (
        "{name} AS MATERIALIZED (SELECT o.k, CASE WHEN n.c IS NULL THEN o.c ELSE n.c END AS c FROM {of} o LEFT JOIN ("
        "SELECT k, list(f ORDER BY i) AS c FROM (SELECT a.k, p.i, "
        "CAST((sum(p.x) - ((sum(p.x) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS f "
        "FROM {by} a JOIN parts p USING (r) GROUP BY ALL) GROUP BY k) n ON o.k = n.k)"
    )
    parts = [
        f"""usable AS (
  SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {width}),
kept AS MATERIALIZED (
  SELECT r, vec_id, list_transform(embedding, lambda c: CAST(floor(1024 * CAST(c AS DOUBLE)) AS BIGINT)) AS x FROM usable),
parts AS MATERIALIZED (SELECT r, unnest(range(1, {width} + 1)) AS i, unnest(x) AS x FROM kept),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS k, x AS c FROM kept
  ORDER BY k LIMIT {k})"""
    ]
    for n in range(rounds):
        parts.append(near.format(name=f"a{n}", of=f"c{n}", k=k, w=width))
        parts.append(step.format(name=f"c{n + 1}", of=f"c{n}", by=f"a{n}"))
    parts.append(near.format(name="a", of=f"c{rounds}", k=k, w=width))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a JOIN c{rounds} c ON a.k = c.k
"""
