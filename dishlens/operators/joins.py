"""Joins of a large table with one that holds each key once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dishlens.operators.spread import estimated_bytes

# Spark's own default for broadcasting; below it a plain join may be planned without a shuffle. Both this and Spark's estimate
# are of compressed bytes, so what lies between `TINY_BYTES` and this is counted: it may hold `HELD_BYTES` in memory.
SMALL_SIDE_BYTES = 10 * 1024 * 1024
TINY_BYTES = 256 * 1024
HELD_BYTES = 32 * 1024 * 1024
SALTS = 16


def _held_small(df: DataFrame) -> bool:
    """Whether a frame's rows, at twice the default widths of their columns, fit the driver and every task."""
    size = estimated_bytes(df)
    if size <= TINY_BYTES or size > SMALL_SIDE_BYTES:
        return size <= SMALL_SIDE_BYTES
    return df.count() * 2 * df._jdf.schema().defaultSize() <= HELD_BYTES


def unless_small(df: DataFrame) -> DataFrame:
    """One side of a join, marked for a sort-merge join unless it is small in memory.

    Spark decides by compressed bytes, which can be a hundredth of the rows that a broadcast gathers in the driver.
    """
    return df if _held_small(df) else df.hint("merge")


def join_unique(
    big: DataFrame, unique: DataFrame, keys: Sequence[str], how: str, salt_by: Sequence[str],
    salts: int = SALTS,
) -> DataFrame:
    """Join where one key may hold a large share of `big`; `unique` has each key at most once.

    A small `unique` is left to Spark's broadcast. A larger one, never broadcast, is joined on a salted key: rows of a
    hot key spread over `salts` tasks by a hash of `salt_by` (columns that tell rows of `big` apart),
    and each row of `unique` goes to all of them. Adaptive skew handling alone would not do: it cannot
    split a join whose other side was just grouped by the key.
    """
    if _held_small(unique):
        return big.join(unique, list(keys), how)
    salt = F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int")
    copies = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")
