"""Scrape-result state machine as set operations.

A restaurant takes any result until its first success; from then on only further successes count,
and their item counts add up (including what a `scraping` row held right before). That makes the
ordered fold a handful of mergeable aggregates, so a restaurant with millions of results is
pre-aggregated in every task instead of being replayed in one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dishlens.constants import SCRAPED, SCRAPING

SALTS = 16


def fold_scrape_results(
    base: DataFrame, events: DataFrame, key: str = "camis", salts: int = SALTS
) -> DataFrame:
    """Apply result events (key, seq, ts, status, item_count, last_error) to the base rows.

    `seq` orders the events of a key and is unique within it. Keys without a base row are ignored,
    as an UPDATE would. Returns the base columns with status, item_count, last_error and scraped_at
    brought forward.
    """
    success = F.col("status") == SCRAPED
    result = F.struct("seq", "status", "item_count", F.nullif("last_error", F.lit("")).alias("err"), "ts")
    salted = events.withColumn("_salt", F.pmod(F.xxhash64("seq"), F.lit(salts)).cast("int"))
    partial = salted.groupBy(key, "_salt").agg(
        F.min(F.when(success, F.col("seq"))).alias("first_success"),
        F.sum(F.when(success, F.col("item_count"))).alias("gained"),
        F.max(F.when(success, result)).alias("last_success"),
        F.max(result).alias("last_any"),
    )
    summary = partial.groupBy(key).agg(
        F.min("first_success").alias("first_success"),
        F.sum("gained").alias("gained"),
        F.max("last_success").alias("last_success"),
        F.max("last_any").alias("last_any"),
    )
    # The row right before the first success: one more pass, joined on the salted key so that a hot
    # restaurant spreads over `salts` tasks.
    bound = (
        summary.filter("first_success IS NOT NULL")
        .select(key, "first_success")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    before = (
        salted.filter(~success)
        .join(bound, [key, "_salt"])
        .filter(F.col("seq") < F.col("first_success"))
        .groupBy(key, "_salt").agg(F.max(F.struct("seq", "status", "item_count")).alias("prior"))
        .groupBy(key).agg(F.max("prior").alias("prior"))
    )
    joined = base.join(summary, key, "left").join(before, key, "left")

    start_status, start_count = F.col("status"), F.coalesce("item_count", F.lit(0))
    done = start_status == SCRAPED
    touched = F.col("last_any").isNotNull()
    succeeded = F.col("last_success").isNotNull()
    held = F.when(F.col("prior").isNotNull(),
                  F.when(F.col("prior.status") == SCRAPING, F.col("prior.item_count"))
                  .otherwise(F.lit(0))) \
        .otherwise(F.when(start_status == SCRAPING, start_count).otherwise(F.lit(0)))
    count = (
        F.when(done & succeeded, start_count + F.col("gained"))
        .when(done, F.col("item_count"))
        .when(succeeded, held + F.col("gained"))
        .when(touched, F.col("last_any.item_count"))
        .otherwise(F.col("item_count"))
    )
    error = (
        F.when(succeeded, F.col("last_success.err"))
        .when(done | ~touched, F.col("last_error"))
        .otherwise(F.col("last_any.err"))
    )
    status = (
        F.when(succeeded | done, F.lit(SCRAPED))
        .when(touched, F.col("last_any.status"))
        .otherwise(start_status)
    )
    stamp = F.when(succeeded, F.col("last_success.ts")).otherwise(F.col("scraped_at"))
    folded = {"status": status, "item_count": count, "last_error": error, "scraped_at": stamp}
    kinds = {f.name: f.dataType for f in base.schema.fields}
    return joined.select(*[
        folded[c].cast(kinds[c]).alias(c) if c in folded else F.col(c) for c in base.columns
    ])
