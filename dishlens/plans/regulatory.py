"""Regulatory tracking: rule-driven extraction and deterministic-key merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.functions.jsonsel import select_json, structured_update
from dishlens.functions.keys import regulatory_key, regulatory_vector_key, rule_key, source_key
from dishlens.operators.joins import join_unique
from dishlens.operators.merge import OLD, last_of_batch, merge_upsert, update_matched


def active_rules(rules: DataFrame) -> DataFrame:
    """One active rule per domain, the one with the smallest id."""
    return rules.filter(F.col("status") == "active").groupBy("domain").agg(
        F.min(F.struct("id", "selector")).alias("rule")
    ).select("domain", F.col("rule.id").alias("rule_id"), F.col("rule.selector").alias("selector"))


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Pages (domain, url, content) with what their domain's rule picks and the update in it.

    `update` stays NULL without a rule, without a match or with an incomplete update: those pages
    are for the slower extraction path.
    """
    joined = join_unique(pages, active_rules(rules), ["domain"], "left", ["url"])
    picked = F.when(F.col("rule_id").isNotNull(), select_json("content", "selector"))
    return joined.withColumn("raw", picked).withColumn("update", structured_update("raw"))


def verify_rules(rules: DataFrame, checks: DataFrame) -> DataFrame:
    """(id, verdict) of proposed rules run against content (rule_id, content)."""
    proposed = rules.filter(F.col("status") == "proposed").select(F.col("id").alias("rule_id"), "selector")
    tried = proposed.join(checks, "rule_id")
    good = structured_update(select_json("content", "selector")).isNotNull()
    return tried.groupBy(F.col("rule_id").alias("id")).agg(
        F.when(F.bool_and(good), F.lit("active")).otherwise(F.lit("rejected")).alias("verdict")
    )


def settle_rules(rules: DataFrame, verdicts: DataFrame, as_of: Column) -> DataFrame:
    """Move proposed rules to active or rejected; rules in any other state stay."""
    proposed = F.col("old.status") == "proposed"
    return update_matched(rules, verdicts, ["id"], {
        "status": F.when(proposed, F.col("new.verdict")).otherwise(F.col("old.status")),
        "activated_at": F.when(proposed & (F.col("new.verdict") == "active"), as_of)
        .otherwise(F.col("old.activated_at")),
    })


def with_update_keys(updates: DataFrame, as_of: Column) -> DataFrame:
    """Keys of table and vector rows for updates (source_id, cas_number, substance_name, ...)."""
    day = F.date_format(as_of, "yyyy-MM-dd")
    return updates.withColumns({
        "id": regulatory_key(F.col("source_id"), day, F.col("cas_number"), F.col("substance_name")),
        "vector_id": regulatory_vector_key(
            F.col("source_id"), F.col("cas_number"), F.col("substance_name")
        ),
        "extracted_at": as_of,
    })


def filled_source_url(updates: DataFrame) -> DataFrame:
    """Updates without a source url take that of their page (page_url)."""
    return updates.withColumn(
        "source_url", F.coalesce(F.nullif("source_url", F.lit("")), F.col("page_url"))
    )


def upsert_updates(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    """On a known key the source, CAS number and raw path stay, everything else follows."""
    fresh = last_of_batch(batch, ["id"], [order])
    return merge_upsert(
        base, fresh, ["id"], rules={"source_id": OLD, "cas_number": OLD, "raw_path": OLD}
    )


def upsert_vectors(base: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    fresh = last_of_batch(batch, ["vector_id"], [order])
    return merge_upsert(base, fresh, ["vector_id"])


def vector_text(substance: Column) -> Column:
    """Text an update without a vector is embedded by."""
    return F.concat(F.lit("search_document: "), substance)


def upsert_sources(base: DataFrame, batch: DataFrame) -> DataFrame:
    """Sources by a key derived from the domain; creation time stays."""
    keyed = batch.withColumn("id", source_key("domain"))
    fresh = last_of_batch(keyed, ["id"], ["updated_at"])
    return merge_upsert(base, fresh, ["id"], rules={"created_at": OLD})


def upsert_proposed_rules(base: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Proposed rules by domain and selector; domain and creation time of a known rule stay."""
    keyed = batch.withColumns({
        "id": rule_key(F.col("domain"), F.col("selector")),
        "status": F.coalesce(F.nullif("status", F.lit("")), F.lit("proposed")),
        "proposed_at": as_of,
    })
    fresh = last_of_batch(keyed, ["id"], ["selector"])
    return merge_upsert(base, fresh, ["id"], rules={"domain": OLD, "activated_at": OLD})


def list_sources(sources: DataFrame) -> DataFrame:
    return sources.orderBy("domain")
