"""Vector scoring: cosine certainty inside the JVM, or over Arrow batches for wide vectors."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

# Above this width one matrix product per Arrow batch is cheaper than a JVM fold per row.
JVM_MAX_DIM = 128


def as_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list<float> Arrow column as a float64 matrix, without a Python object per row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, dim)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    """Euclidean length. Stored next to the vector at index time, it saves a fold per query."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def certainty(
    vector: Column | str,
    query: Sequence[float],
    stored_norm: Column | str | None = None,
    engine: str = "auto",
) -> Column:
    """1 - cosine distance to one query vector."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    query = [float(x) for x in query]
    length = math.sqrt(sum(x * x for x in query))
    if length == 0:
        return F.lit(None).cast("double")
    if engine == "auto":
        engine = "jvm" if len(query) <= JVM_MAX_DIM else "arrow"
    if engine == "arrow":
        return _arrow_certainty(query)(vector)
    literal = F.array(*[F.lit(x) for x in query])
    if stored_norm is None:
        own = norm(vector)
    else:
        own = F.col(stored_norm) if isinstance(stored_norm, str) else stored_norm
    return F.when(own > 0, dot(vector, literal) / (own * F.lit(length)))


def _arrow_certainty(query: list[float]):
    unit = np.asarray(query) / (math.sqrt(sum(x * x for x in query)) or 1.0)
    dim = len(query)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
        matrix = as_matrix(column.filter(fits), dim)
        lengths = np.sqrt((matrix * matrix).sum(axis=1))
        with np.errstate(divide="ignore", invalid="ignore"):
            values = np.where(lengths > 0, matrix @ unit / lengths, np.nan)
        out = np.full(len(column), np.nan)
        out[fits.to_numpy(zero_copy_only=False)] = values
        return pa.array(out, mask=np.isnan(out))

    # nondeterministic in name only: a filter on the score must not evaluate it a second time
    return score.asNondeterministic()


def dimension_error(vector: Column | str, dim: int) -> Column:
    """Reason text for a vector of the wrong width, NULL for a good one."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.when(vector.isNull(), F.lit("missing vector")).when(
        F.size(vector) != dim,
        F.concat(F.lit("vector has dim "), F.size(vector).cast("string"), F.lit(f", expected {dim}")),
    )


def split_by_dimension(df: DataFrame, vector: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with vectors of the right width, and the rest with a `reason` for the dead letters."""
    reason = dimension_error(vector, dim)
    return df.filter(reason.isNull()), df.withColumn("reason", reason).filter("reason IS NOT NULL")
