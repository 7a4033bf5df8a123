"""Run summaries counted on the way, without a second pass over the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F


def counted(df: DataFrame, name: str, **parts: Column) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation of their number (`rows`) and of the rows that meet each named
    condition. The figures are there once an action has run over the returned frame."""
    observation = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows")]
    metrics += [F.count_if(condition).alias(part) for part, condition in parts.items()]
    return df.observe(observation, *metrics), observation
