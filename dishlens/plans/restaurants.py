"""Restaurant table: merges along the life cycle, listings and operational reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.constants import (
    FAILED_PERMANENTLY, FAILED_SCRAPE, JOB_KINDS, NS_OID, PENDING_DISCOVERY, SCRAPED, SCRAPING,
    TIER_IMAGE, URL_FOUND,
)
from dishlens.functions.keys import uuid5
from dishlens.functions.urls import canonical
from dishlens.operators.filters import contains_text, equals
from dishlens.operators.merge import NEW_OR_OLD, merge_upsert, update_matched
from dishlens.operators.paging import paginate

# Columns the inspection import owns; discovery and scraping own the rest.
IMPORT_COLUMNS = [
    "dba", "boro", "building", "street", "zipcode", "phone", "address", "cuisine",
    "latitude", "longitude", "nta",
]


# ---------------------------------------------------------------- merges

def _surrogate(key: str) -> Column:
    """Id of a new row, derived from its outside key: a task that runs again gives the same."""
    return uuid5(NS_OID, F.concat_ws("|", F.lit(key), F.col(key)))


def upsert_inspected(
    base: DataFrame, batch: DataFrame, new_id: Column | None = None, as_of: Column | None = None,
) -> DataFrame:
    """Import by camis: a missing address keeps the old one, life-cycle columns are not touched, new
    restaurants await discovery."""
    rows = batch.select("camis", *IMPORT_COLUMNS)
    return merge_upsert(
        base, rows, ["camis"],
        rules={"address": NEW_OR_OLD},
        on_insert={
            "id": _surrogate("camis") if new_id is None else new_id,
            "status": F.lit(PENDING_DISCOVERY),
        },
        as_of=as_of,
    )


def upsert_outside(
    base: DataFrame, businesses: DataFrame, new_id: Column | None = None, as_of: Column | None = None,
) -> DataFrame:
    """Union with the outside id space by yelp_id: only the name follows, new rows count as scraped."""
    rows = businesses.select(F.col("business_id").alias("yelp_id"), F.col("name").alias("dba"))
    outside = base.filter("yelp_id IS NOT NULL")
    merged = merge_upsert(
        outside, rows, ["yelp_id"],
        on_insert={
            "id": _surrogate("yelp_id") if new_id is None else new_id, "status": F.lit(SCRAPED),
        },
        as_of=as_of,
    )
    return base.filter("yelp_id IS NULL").unionByName(merged)


def id_map(base: DataFrame) -> DataFrame:
    return base.filter("yelp_id IS NOT NULL").select("yelp_id", "id")


def apply_discovery(base: DataFrame, found: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Discovery results (camis, website_url, menu_urls, url_source, address, phone)."""
    def filled(name: str) -> Column:
        return F.nullif(F.col(f"new.{name}"), F.lit(""))

    any_url = filled("website_url").isNotNull() | (F.coalesce(F.size("new.menu_urls"), F.lit(0)) > 0)
    return update_matched(base, found, ["camis"], {
        "website_url": filled("website_url"),
        "menu_urls": F.col("new.menu_urls"),
        "url_source": filled("url_source"),
        "address": F.coalesce(filled("address"), F.col("old.address")),
        "phone": F.coalesce(filled("phone"), F.col("old.phone")),
        "status": F.when(any_url, F.lit(URL_FOUND)).otherwise(F.lit(FAILED_PERMANENTLY)),
    }, as_of=as_of)


def set_tiers(base: DataFrame, tiers: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Extraction tiers (camis, extraction_tier); '' clears."""
    return update_matched(base, tiers, ["camis"], {
        "extraction_tier": F.nullif(F.col("new.extraction_tier"), F.lit("")),
    }, as_of=as_of)


# ---------------------------------------------------------------- listings

def restaurant_filter(status: str = "", name: str = "") -> Column:
    return equals(status.strip(), "status") & contains_text(name.strip(), "dba")


def list_restaurants(
    base: DataFrame, status: str = "", name: str = "", offset: int = 0, limit: int = 50
) -> DataFrame:
    rows = base.filter(restaurant_filter(status, name))
    return paginate(rows, [F.desc_nulls_first("created_at"), F.asc("id")], offset, limit)


def count_restaurants(base: DataFrame, status: str = "", name: str = "") -> DataFrame:
    return base.filter(restaurant_filter(status, name)).agg(F.count(F.lit(1)).alias("total"))


def open_work(base: DataFrame) -> DataFrame:
    """Restaurants that are not scraped yet, with their number of urls."""
    return base.filter(F.col("status") != SCRAPED).select(
        "camis", "dba", "status", F.nullif(F.size("menu_urls"), F.lit(0)).alias("url_count")
    )


def anti_bot_failures(base: DataFrame) -> DataFrame:
    blocked = F.col("last_error").contains("status 403") | F.col("last_error").contains("status 429")
    return base.filter((F.col("status") == FAILED_SCRAPE) & blocked).select("camis", "dba", "last_error")


def partial_extractions(base: DataFrame, links: DataFrame) -> DataFrame:
    """Image extractions with one to three items whose site links an ordering platform (camis, link)
    that the stored urls lack."""
    suspects = base.filter(
        (F.col("extraction_tier") == TIER_IMAGE) & F.col("item_count").between(1, 3)
    ).select("camis", "item_count", "menu_urls")
    stored = suspects.select("camis", F.explode("menu_urls").alias("url")).select(
        "camis", canonical("url").alias("key")
    )
    missing = (
        links.withColumn("key", canonical("link")).join(suspects.select("camis", "item_count"), "camis")
        .join(stored, ["camis", "key"], "left_anti")
    )
    return missing.select("camis", "item_count", "link")


def retry_actions(base: DataFrame, listing: bool = False) -> DataFrame:
    """What a retry of each restaurant does: scrape again when urls are known, else discover.

    The batch form takes the failed scrapes; the `listing` form takes every row but scrapes again
    only from a state that allows it.
    """
    has_urls = F.coalesce(F.size("menu_urls"), F.lit(0)) > 0
    if listing:
        again = F.col("status").isin(FAILED_SCRAPE, SCRAPED, URL_FOUND, SCRAPING, FAILED_PERMANENTLY)
        scrape, rows = has_urls & again, base
    else:
        scrape, rows = has_urls, base.filter(F.col("status") == FAILED_SCRAPE)
    return rows.select(
        "camis", "dba",
        F.when(scrape, F.lit("scrape")).otherwise(F.lit("discover")).alias("action"),
        F.when(scrape, F.lit(URL_FOUND)).otherwise(F.lit(PENDING_DISCOVERY)).alias("next_status"),
    )


# ---------------------------------------------------------------- reports

def status_counts(base: DataFrame) -> DataFrame:
    """Restaurants and items per status."""
    return base.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("items")
    )


def pipeline_totals(base: DataFrame) -> DataFrame:
    return base.agg(
        F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("total_items")
    )


def tier_counts(base: DataFrame, with_none: bool = False) -> DataFrame:
    """Successes and items per extraction tier; rows without one are left out or shown as (none)."""
    scraped = base.filter(F.col("status") == SCRAPED)
    tier = F.col("extraction_tier")
    if with_none:
        scraped, tier = scraped, F.coalesce(tier, F.lit("(none)"))
    else:
        scraped = scraped.filter(F.coalesce(tier, F.lit("")) != "")
    return scraped.groupBy(tier.alias("tier")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("item_count"), F.lit(0)).alias("items")
    )


def failure_reason(error: Column | str) -> Column:
    """Coarse reason: text before the first colon, digit runs as N, at most 80 characters."""
    error = F.col(error) if isinstance(error, str) else error
    head = F.regexp_replace(F.split_part(error, F.lit(":"), F.lit(1)), "[0-9]+", "N")
    return F.substring(head, 1, 80)


def failure_taxonomy(base: DataFrame, top: int = 10) -> DataFrame:
    failed = base.filter((F.col("status") == FAILED_SCRAPE) & (F.coalesce("last_error", F.lit("")) != ""))
    return (
        failed.groupBy(failure_reason("last_error").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc("reason")).limit(top)
    )


def error_counts(base: DataFrame) -> DataFrame:
    return base.filter(F.col("status") == FAILED_SCRAPE).groupBy("last_error").agg(
        F.count(F.lit(1)).alias("n")
    )


def item_histogram(base: DataFrame) -> DataFrame:
    count = F.col("item_count")
    bucket = (
        F.when(count == 0, "0").when(count < 10, "1-9").when(count < 30, "10-29").otherwise("30+")
    )
    return base.filter(F.col("status") == SCRAPED).groupBy(bucket.alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )


def high_water(base: DataFrame, column: str = "updated_at") -> DataFrame:
    epoch = F.lit("1970-01-01 00:00:00").cast(base.schema[column].dataType)
    return base.agg(F.coalesce(F.max(column), epoch).alias("since"))


# ---------------------------------------------------------------- jobs

def job_counts(jobs: DataFrame, as_of: Column, kinds: list[str] = JOB_KINDS) -> DataFrame:
    """Jobs per kind and state; finished ones only of the last 24 hours."""
    recent = F.col("finalized_at").isNull() | (F.col("finalized_at") > as_of - F.expr("INTERVAL '24' HOUR"))
    return jobs.filter(F.col("kind").isin(kinds) & recent).groupBy("kind", "state").agg(
        F.count(F.lit(1)).alias("n")
    )


def scheduled_backlog(jobs: DataFrame) -> DataFrame:
    return jobs.filter(F.col("state") == "scheduled").groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("scheduled_at").alias("first_at"), F.max("scheduled_at").alias("last_at"),
    )


def job_errors(jobs: DataFrame, kind: str, state: str, argument: str) -> DataFrame:
    """Jobs of a kind and state with one argument and their last error (JSON columns)."""
    last = F.try_element_at(F.from_json("errors", "array<struct<error: string>>"), F.lit(-1))
    return jobs.filter((F.col("kind") == kind) & (F.col("state") == state)).select(
        "id", F.get_json_object("args", f"$.{argument}").alias(argument), last["error"].alias("last_error")
    )


def discarded_jobs(jobs: DataFrame, limit: int) -> DataFrame:
    rows = jobs.filter(F.col("state") == "discarded")
    return rows.orderBy(F.desc_nulls_last("final_attempt_at"), F.asc("id")).limit(limit)


def staggered_schedule(
    restaurants: DataFrame, as_of: Column, stagger_seconds: int = 15
) -> DataFrame:
    """One scrape job per url, each some seconds after the one before it in the list."""
    step = stagger_seconds if stagger_seconds > 0 else 15
    return restaurants.select("camis", F.posexplode("menu_urls").alias("pos", "url")).select(
        "camis", "url", "pos",
        (as_of + F.make_dt_interval(secs=(F.col("pos") * step).cast("decimal(18,6)"))).alias("scheduled_at"),
    )


def unique_in_period(jobs: DataFrame, args: list[str], ts: str, seconds: int) -> DataFrame:
    """First job per argument set and period bucket."""
    bucket = F.floor(F.unix_timestamp(F.col(ts).cast("timestamp")) / seconds)
    keyed = jobs.withColumn("period", bucket)
    return keyed.groupBy(*args, "period").agg(F.min(ts).alias(ts), F.count(F.lit(1)).alias("merged"))
