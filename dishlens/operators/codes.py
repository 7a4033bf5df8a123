"""Nearest neighbours over vectors of one byte a number, exact all the same.

A stored table has two folders, both sorted by id: `codes` with an int8 code per number, a scale and a bound of the rounding
error, and `vectors` with the rows themselves. A search scans codes only. A row's certainty lies within its error of
what the code says, so only rows whose upper end reaches the k-th best lower end can be in the answer; these few are
read from `vectors` by id and scored exactly.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dishlens.functions.vectors import as_matrix, certainty

# So many candidates are named in the filter of the vectors' scan; more are joined.
MAX_NAMED = 10_000
_ROUNDING = 1e-9  # of float64 sums, far below an int8 step


def coded(vector: Column | str, dim: int) -> Column:
    """struct(code, scale, error) of the vector's direction; null without one (null, zero, other width, not finite)."""

    @F.arrow_udf("struct<code: binary, scale: double, error: double>")
    def code(column: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False)
        matrix = np.zeros((len(column), dim))
        if fits.any():
            matrix[fits] = as_matrix(column.filter(pa.array(fits)), dim)
        length = np.sqrt((matrix * matrix).sum(axis=1))
        good = np.isfinite(length) & (length > 0)
        unit = np.where(good[:, None], matrix, 0) / np.where(good, length, 1)[:, None]
        scale = np.where(good, np.abs(unit).max(axis=1, initial=0), 1) / 127
        codes = np.rint(unit / scale[:, None]).astype(np.int8)
        error = np.sqrt(((unit - codes * scale[:, None]) ** 2).sum(axis=1)) + _ROUNDING
        raw = pa.array([row.tobytes() for row in codes], pa.binary())
        return pa.StructArray.from_arrays([raw, pa.array(scale), pa.array(error)], ["code", "scale", "error"], mask=pa.array(~good))

    return code(F.col(vector) if isinstance(vector, str) else vector)


def store(df: DataFrame, vector: str, id_col: str, dim: int, root: str, partitions: int | None = None) -> None:
    """Write codes and rows below `root`. Ids are non-null and unique; rows without direction have no code."""
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    placed = df.repartitionByRange(n, id_col).sortWithinPartitions(id_col)
    placed.write.mode("overwrite").parquet(f"{root}/vectors")
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{root}/vectors")
    codes = rows.select(id_col, coded(vector, dim).alias("c")).filter("c IS NOT NULL").select(id_col, "c.*")
    codes.write.mode("overwrite").parquet(f"{root}/codes")


@dataclass(frozen=True)
class Read:
    """What a search had to read, in bytes of numbers, against the plain scan."""

    rows: int
    candidates: int
    code_bytes: int
    vector_bytes: int
    plain_bytes: int


def _guess(query: Sequence[float]) -> Column:
    unit = np.asarray(query, float)
    unit = unit / np.sqrt((unit * unit).sum())

    @F.arrow_udf("double")
    def score(code: pa.Array, scale: pa.Array) -> pa.Array:
        matrix = np.frombuffer(b"".join(code.to_pylist()), np.int8).reshape(-1, len(unit))
        return pa.array(matrix @ unit * scale.to_numpy(zero_copy_only=False))

    # nondeterministic in name only: a filter on it must not evaluate it a second time
    return score.asNondeterministic()("code", "scale")


def candidates(codes: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """Rows whose certainty may be among the k best; the bound is a subquery over the same codes."""
    guessed = codes.withColumn("_guess", _guess(query))
    lower = guessed.select((F.col("_guess") - F.col("error")).alias("low"))
    kth = lower.orderBy(F.desc("low")).limit(k).agg(F.min("low").alias("low"))
    return guessed.filter(F.col("_guess") + F.col("error") >= kth.scalar()).drop("_guess")


def nearest_stored(
    spark: SparkSession, root: str, schema, vector: str, query: Sequence[float], k: int, id_col: str,
) -> tuple[DataFrame, Read]:
    """The rows `knn.nearest` gives over the whole table (ties by id), and what was read for them."""
    rows = spark.read.schema(schema).parquet(f"{root}/vectors")
    codes = spark.read.parquet(f"{root}/codes")
    dim, total = len(query), codes.count()
    if not any(query):
        return rows.withColumn("certainty", F.lit(None).cast("double")).limit(0), Read(total, 0, 0, 0, 4 * dim * total)
    found = candidates(codes, query, k).select(id_col)
    named = [r[0] for r in found.limit(MAX_NAMED + 1).collect()]
    if len(named) <= MAX_NAMED:
        near = rows.filter(F.col(id_col).isin(named))
    else:
        near = rows.join(found, id_col, "left_semi")
    scored = near.withColumn("certainty", certainty(vector, query)).filter("certainty IS NOT NULL")
    read = Read(total, len(named), 2 * (dim + 16) * total, 4 * dim * len(named), 4 * dim * total)
    return scored.orderBy(F.desc("certainty"), F.asc(id_col)).limit(k), read
