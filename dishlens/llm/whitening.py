"""Whitening of embeddings by shifted CholeskyQR.

The centred rows of the fit list, a matrix X, are never moved: each pass computes Q = X / R_1 / R_2 ... block by block
through triangular solves and adds up the Gram matrices of the blocks. The first Gram matrix is factored with a
shift, which keeps ill-conditioned data positive definite; each further pass makes Q more orthogonal and gives one more
factor, until the Gram matrix is the identity or passes run out. With R the product of all factors, X'X = R'R, so the right singular
vectors of the small matrix R are the components and its squared singular values, over n, the eigenvalues. Columns are
centred before anything is multiplied: whole numbers less the whole part of the mean, exactly, then less its rest.

What reaches the driver is one number per pair of dimensions, added up by Spark; the fit list is each distinct vector
once, so many copies of one vector meet in partial aggregation first.

Rows: vectors that are null or hold nulls or non-finite entries are left out; so are those of another width than most
vectors of the fit list have (of equally many the smaller), and empty ones. 64 c beyond +-2^40 stands for that bound. Repeated
rows and null ids stay rows. Only components with variance (e over 1e-24 of the largest) are numbered, so n equal
vectors or one vector give no rows. `deviation` is null where it exceeds a long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import written

COMPONENTS, PASSES, NEAR, NOTHING = 16, 6, 1e-13, 1e-24
_LIMIT = 1 << 40


def scaled(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): usable vectors as whole numbers."""
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    whole = F.transform("embedding", lambda c: F.floor(
        F.greatest(F.lit(-float(_LIMIT)), F.least(F.lit(float(_LIMIT)), c.cast("double") * 64))) + 1_000_000)
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("x")
    )


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], cells: int, exact: bool = False) -> np.ndarray:
    """Sum over all vectors of `part(block)`, an array of that many cells; one array a task is shuffled.

    `exact` takes longs and gives Python integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                found = part(np.stack(pdf["x"].to_list()))
                total = found if total is None else total + found
        if total is not None:
            yield pd.DataFrame({"values": [total.ravel()]})

    per_task = rows.select("x").mapInPandas(run, f"values array<{'long' if exact else 'double'}>")
    value = F.col("v").cast("decimal(38,0)") if exact else F.col("v")
    found = per_task.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.sum(value).alias("v")).collect()
    out = np.zeros(cells, object if exact else float)
    for row in found:
        out[row["at"]] = int(row["v"]) if exact else row["v"]
    return out


@dataclass(frozen=True)
class Mean:
    """Sums over n vectors; the mean's whole part and rest."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        floors = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - floors).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n x - S)^2, None beyond a long."""
        floors = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([s % self.n for s in self.sums], object)
        away = x - floors
        top = max(int(np.abs(away).max(initial=0)), 1) * self.n + self.n
        kind = np.int64 if top * top * max(len(self.sums), 1) < 1 << 62 else object
        found = ((self.n * away.astype(kind) - rest.astype(kind)) ** 2).sum(1)
        return [int(v) if v < 1 << 63 else None for v in found]


def solved(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x / r for an upper triangular r, column by column."""
    q = np.empty_like(x)
    for j in range(r.shape[1]):
        q[:, j] = (x[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
    return q


@dataclass(frozen=True)
class Components:
    mean: Mean
    vectors: np.ndarray  # dimension x component
    values: np.ndarray
    trace: float

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.mean.centred(x) @ self.vectors / np.sqrt(self.values)


def fit_list(rows: DataFrame) -> tuple[DataFrame, int]:
    """Each distinct vector of the prevailing width once, and that width (0 without vectors)."""
    fit = written(rows.select("x").distinct(), "fit")
    found = fit.groupBy(F.size("x").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = found["width"] if found else 0
    return fit.filter(F.size("x") == width), width


def fitted(fit: DataFrame, width: int) -> Components:
    ends = summed(fit, lambda x: np.append(x.sum(0), len(x)), width + 1, exact=True)
    mean = Mean(int(ends[-1]), [int(s) for s in ends[:-1]])
    factors: list[np.ndarray] = []

    def gram(x: np.ndarray) -> np.ndarray:
        q = mean.centred(x)
        for r in factors:
            q = solved(q, r)
        return q.T @ q

    size, eps = width * width, np.finfo(float).eps
    upper, product = None, np.eye(width)
    for turn in range(PASSES):
        g = summed(fit, gram, size).reshape(width, width)
        g = (g + g.T) / 2
        try:
            # a rest of non-orthogonality stays in the last Gram matrix and enters R through its own factor
            upper = np.linalg.cholesky(g).T
            if turn and np.abs(g - np.eye(width)).max() < NEAR:
                break
        except np.linalg.LinAlgError:
            upper = None
        if turn == 0 or upper is None:
            shift = 11 * (width * (width + 1)) * eps * max(float(np.trace(g)), np.finfo(float).tiny)
            step = np.linalg.cholesky(g + shift * np.eye(width)).T
        else:
            step = upper
        if turn == PASSES - 1:
            break
        factors.append(step)
        product, upper = step @ product, None
    if upper is None:  # vectors in a subspace: a symmetric root serves as the last factor
        values, turned = np.linalg.eigh(g)
        upper = turned * np.sqrt(np.maximum(values, 0)) @ turned.T
    _, sigma, rows = np.linalg.svd(upper @ product)
    e = sigma**2 / mean.n
    count = int((e[:COMPONENTS] > NOTHING * e[0]).sum()) if e[0] > 0 else 0
    return Components(mean, rows[:count].T, e[:count], float(e.sum()))


def longs(values: list[int], missing, times: int) -> pd.api.extensions.ExtensionArray:
    """Each value so many times, null where it is missing."""
    return pd.arrays.IntegerArray(np.repeat(np.array(values, np.int64), times), np.repeat(np.array(missing, bool), times))


def whitened(vectors: DataFrame) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) per usable row and component."""
    schema = (
        "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )
    rows = scaled(vectors)
    fit, width = fit_list(rows)
    if not width:
        return rows.sparkSession.createDataFrame([], schema)
    found = fitted(fit, width)
    k = len(found.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)

    def second(x: np.ndarray) -> np.ndarray:
        w = found.whitened(x)
        return w.T @ w

    covariance = summed(fit, second, k * k).reshape(k, k) / found.mean.n
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = found.values / found.trace

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_list())
            away = found.mean.deviations(x)
            yield pd.DataFrame({
                "vec_id": longs(pdf["id"].to_list(), pdf["missing"], k),
                "component": np.tile(np.arange(1, k + 1), len(x)), "n": found.mean.n,
                "deviation": longs([v or 0 for v in away], [v is None for v in away], k),
                "whitened": found.whitened(x).ravel(), "explained": np.tile(explained, len(x)), "identity_error": error,
            })

    numbered = rows.filter(F.size("x") == width).select(
        F.coalesce("vec_id", F.lit(0)).alias("id"), F.col("vec_id").isNull().alias("missing"), "x"
    )
    return numbered.mapInPandas(run, schema)
