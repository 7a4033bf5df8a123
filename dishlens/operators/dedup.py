"""Row choice per key. The rank filters become group limits, so each task sends at most `n` rows per
key to the shuffle, however hot the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dishlens.functions.urls import canonical


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1,
                rank_col: str | None = None) -> DataFrame:
    """First `n` rows per key in the given order (make it total for a stable result)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank_col) if rank_col else ranked.drop("_rank")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def distinct_urls(df: DataFrame, owner: str, url: str, pos: str) -> DataFrame:
    """Urls per owner without repeats (blanks around and one trailing slash do not count); the first
    spelling stays."""
    first = F.struct(F.col(pos).alias(pos), F.col(url).alias(url))
    return (
        df.groupBy(owner, canonical(url).alias("_canonical"))
        .agg(F.min(first).alias("_first"))
        .select(owner, f"_first.{pos}", f"_first.{url}")
    )
