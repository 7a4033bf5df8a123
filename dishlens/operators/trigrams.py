"""Pattern filters by an index of trigrams.

The index is a table (trigram, id), sorted by trigram. A pattern's literal runs, between its wildcards, say which trigrams a
matching text must hold; ids that have them all are candidates, and ILIKE decides on their rows. So answers are those of the
scan, wildcards included. A pattern without a run of three characters names no trigram and is answered by the scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the lower-cased text."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.char_length(low) - 2, F.lit(1)))
    return F.when(F.char_length(low) >= 3, F.array_distinct(F.transform(places, lambda p: F.substring(low, p, 3)))).otherwise(
        F.array().cast("array<string>")
    )


def write_trigrams(df: DataFrame, column: str, id_col: str, root: str) -> None:
    """Index a column below `root`. Ranges are of trigram and id, so a trigram of every row is in many tasks."""
    rows = df.filter(F.col(column).isNotNull()).select(F.explode(trigrams(F.col(column))).alias("trigram"), F.col(id_col).alias("id"))
    rows.repartitionByRange("trigram", "id").sortWithinPartitions("trigram", "id").write.mode("overwrite").parquet(root)


def literal_runs(pattern: str) -> list[str]:
    """The runs between wildcards, escapes resolved."""
    parts = re.split(r"(?<!\\)(?:\\\\)*[%_]", pattern)
    return [re.sub(r"\\(.)", r"\1", part) for part in parts if part]


def matching(spark: SparkSession, df: DataFrame, column: str, id_col: str, root: str, pattern: str) -> DataFrame:
    """Rows of `df` whose column is ILIKE the pattern; the same rows as `df.filter(col(column).ilike(pattern))`."""
    keep = F.col(column).ilike(pattern)
    wanted = F.array_distinct(F.flatten(F.array(*[trigrams(F.lit(run)) for run in literal_runs(pattern)] or [F.array().cast("array<string>")])))
    names = spark.range(1).select(F.explode(wanted)).toPandas().iloc[:, 0].tolist()
    if not names:
        return df.filter(keep)
    found = spark.read.parquet(root).filter(F.col("trigram").isin(names)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ids = found.filter(F.col("n") == len(names)).select(F.col("id").alias(id_col))
    return df.join(ids, id_col, "left_semi").filter(keep)
