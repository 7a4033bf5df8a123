"""Counts kept up to date from changes.

A change of a row takes what it counted for out of its old group and puts it into the new one. A batch leaves one row of
differences per group it touched, in a folder of its own number, so a batch that runs again counts once. The current
counts are those of the start plus all differences; the rows themselves are never read again.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.operators.snapshots import append_batch, read_batches


def totals(rows: DataFrame, groups: Mapping[str, Column], measures: Mapping[str, Column], sign: int = 1) -> DataFrame:
    """Sum of each measure per group; measures that are NULL count as nothing."""
    sums = [(F.coalesce(F.sum(m), F.lit(0)) * sign).cast("long").alias(n) for n, m in measures.items()]
    return rows.groupBy(*[c.alias(n) for n, c in groups.items()]).agg(*sums)


def added(parts: Sequence[DataFrame], groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Counts and differences added up; groups that have come down to nothing are gone."""
    rows = reduce(DataFrame.unionByName, [p.select(*groups, *measures) for p in parts])
    sums = rows.groupBy(*groups).agg(*[F.sum(m).alias(m) for m in measures])
    return sums.filter(reduce(Column.__or__, [F.col(m) != 0 for m in measures]))


def status_differences(changed: DataFrame) -> DataFrame:
    """(status, n, items) by which changed rows (`scrape_states`, kind `state`) move the counts by status."""
    # both sides of a change leave its row together: reading `changed` twice would run the stream's state twice
    sides = F.array(
        F.struct(F.col("old_status").alias("status"), F.lit(-1).alias("n"), (-F.col("old_item_count")).alias("items")),
        F.struct("status", F.lit(1).alias("n"), F.col("item_count").alias("items")),
    )
    rows = changed.filter("kind = 'state'").select(F.inline(sides))
    return added([totals(rows, {"status": F.col("status")}, {"n": F.col("n"), "items": F.col("items")})], ["status"], ["n", "items"])


def differences_sink(root: str, differences: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Each batch's differences below `root`: a few rows, whatever the batch's size."""

    def sink(batch: DataFrame, number: int) -> None:
        append_batch(differences(batch).coalesce(1), root, number)

    return sink


def current(start: DataFrame, root: str, groups: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """The counts of the start brought up to date by the differences of all batches."""
    kinds = ", ".join(f"{c} {start.schema[c].dataType.simpleString()}" for c in (*groups, *measures))
    return added([start, read_batches(start.sparkSession, root, kinds)], groups, measures)
