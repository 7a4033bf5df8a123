"""Ingredient catalog: validation, listing, statistics, merges, look-up and product roll-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.constants import GROUPS, LEVEL_RANK, LEVELS
from dishlens.functions.arrays import ingredient_names, or_empty, strip_tag_locale
from dishlens.functions.text import name_key, trim_space
from dishlens.operators.filters import catalog_filter
from dishlens.operators.joins import join_unique
from dishlens.operators.knn import common_width, nearest_match
from dishlens.operators.merge import delete_keys, insert_absent, last_of_batch, merge_upsert
from dishlens.operators.paging import paginate


def _compact(reasons: Mapping[str, Column]) -> Column:
    tests = F.array(*[F.when(bad, F.lit(reason)) for reason, bad in reasons.items()])
    return F.array_compact(tests)


def entry_errors(name: Column, level: Column, groups: Column) -> Column:
    """What is wrong with a catalog entry; empty when it may be stored."""
    trimmed, listed = trim_space(name), or_empty(groups)
    known = F.array(*[F.lit(g) for g in GROUPS])
    return _compact({
        "blank name": F.coalesce(trimmed, F.lit("")) == "",
        "control characters in name": trimmed.rlike(r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"),
        "name above 200 bytes": F.octet_length(trimmed) > 200,
        "blank level": F.coalesce(level, F.lit("")) == "",
        "unknown level": (level != "") & ~level.isin(LEVELS),
        "repeated groups": F.size(F.array_distinct(listed)) < F.size(listed),
        "unknown group": F.size(F.array_except(listed, known)) > 0,
    })


def corpus_errors(level: Column, groups: Column, substitutions: Column) -> Column:
    """Rules the whole catalog keeps: only harmful entries name groups to avoid and replacements."""
    has_groups, has_subs = F.size(or_empty(groups)) > 0, F.size(or_empty(substitutions)) > 0
    return _compact({
        "needs groups": (level != "low") & ~has_groups,
        "needs substitutions": (level != "low") & ~has_subs,
        "low entry has substitutions": (level == "low") & has_subs,
    })


def list_entries(
    catalog: DataFrame, search: str = "", level: str = "", group: str = "",
    offset: int = 0, limit: int = 20,
) -> DataFrame:
    rows = catalog.filter(catalog_filter(search, level, group))
    return paginate(rows, [F.asc("ingredient")], offset, limit)


def count_entries(catalog: DataFrame, search: str = "", level: str = "", group: str = "") -> DataFrame:
    return catalog.filter(catalog_filter(search, level, group)).agg(F.count(F.lit(1)).alias("total"))


def catalog_counts(catalog: DataFrame) -> DataFrame:
    """(kind, name, n): the total, entries per level, entries per group, in one pass."""
    facts = F.concat(
        F.array(F.struct(F.lit("total").alias("kind"), F.lit("").alias("name")),
                F.struct(F.lit("level").alias("kind"), F.col("level").alias("name"))),
        F.transform(or_empty("groups"), lambda g: F.struct(F.lit("group").alias("kind"), g.alias("name"))),
    )
    return (
        catalog.select(F.explode(facts).alias("fact")).groupBy("fact.kind", "fact.name")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def catalog_stats(catalog: DataFrame) -> DataFrame:
    """One row: total, map of level counts, map of group counts."""
    counts = catalog_counts(catalog)

    def as_map(kind: str) -> Column:
        entry = F.when(F.col("kind") == kind, F.struct("name", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    return counts.agg(
        F.coalesce(F.max(F.when(F.col("kind") == "total", F.col("n"))), F.lit(0)).alias("total"),
        as_map("level").alias("level_counts"), as_map("group").alias("group_counts"),
    )


# ---------------------------------------------------------------- merges

def _prepared(batch: DataFrame) -> DataFrame:
    return batch.withColumns({
        "ingredient": name_key("ingredient"),
        "groups": or_empty("groups"),
        "substitutions": or_empty("substitutions"),
    })


def seed(catalog: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Add unknown ingredients; known ones stay as they are."""
    fresh = last_of_batch(_prepared(batch), ["ingredient"], []).withColumn("updated_at", as_of)
    return insert_absent(catalog, fresh, ["ingredient"])


def seed_marker(meta: DataFrame, value: str) -> DataFrame:
    """Key-value marker (key, value) that the catalog was seeded."""
    row = meta.sparkSession.createDataFrame([("seeded", value)], "key string, value string")
    return merge_upsert(meta, row, ["key"])


def reseed(catalog: DataFrame, batch: DataFrame, as_of: Column) -> DataFrame:
    """Overwrite known ingredients and add the others, stamping the change time."""
    fresh = last_of_batch(_prepared(batch), ["ingredient"], []).withColumn("updated_at", as_of)
    return merge_upsert(catalog, fresh, ["ingredient"])


def upsert_vectors(vectors: DataFrame, batch: DataFrame, order: str) -> DataFrame:
    fresh = last_of_batch(_prepared(batch), ["ingredient"], [order])
    return merge_upsert(vectors, fresh, ["ingredient"])


def delete_entries(catalog: DataFrame, names: DataFrame) -> DataFrame:
    return delete_keys(catalog, names.select(name_key("ingredient").alias("ingredient")), ["ingredient"])


# ---------------------------------------------------------------- look-up and roll-up

def lookup(
    ingredients: DataFrame, catalog: DataFrame, vectors: bool = False, threshold: float | None = None,
    salt_by: Sequence[str] = ("item_id",), dim: int | None = None,
) -> DataFrame:
    """Catalog match of each row (item_id, ingredient[, embedding]): by name first, else nearest.

    The nearest entry counts as found however far it is, unless a threshold is set. Adds
    `matched`, `level`, `groups`, `certainty`; unmatched rows carry NULLs. `salt_by` tells rows apart,
    so that an ingredient in every product can be spread. Vectors of another width than `dim`, by default
    the width most catalog entries have, match nothing (`split_by_dimension` lists them); the result has no vectors.
    """
    facts = catalog.select(
        F.col("ingredient").alias("_key"), F.col("ingredient").alias("matched"), "level", "groups"
    )
    keyed = ingredients.withColumn("_key", name_key("ingredient"))
    if not vectors:
        exact = join_unique(keyed, facts, ["_key"], "left", salt_by)
        certain = F.when(F.col("matched").isNotNull(), F.lit(1.0))
        return exact.withColumn("certainty", certain).drop("_key")
    dim = common_width(catalog, "embedding") if dim is None else dim
    # Only rows that no name matches need vectors, and these never cross a join with facts.
    names = facts.select("_key")
    unnamed = keyed.select("_key", "item_id", "embedding").join(names, "_key", "left_anti")
    found = nearest_match(unnamed, "embedding", "item_id", catalog, "embedding", "ingredient", dim=dim or 1)
    if threshold is not None:
        found = found.filter(F.col("certainty") >= threshold)
    found = found.select("item_id", F.col("ingredient").alias("_near"), "certainty")
    rest = keyed.drop("embedding").join(found, "item_id", "left")
    # A row is looked up once: under its own name, or else under that of its nearest entry.
    asked = rest.withColumn("_key", F.coalesce("_near", "_key"))
    joined = join_unique(asked, facts, ["_key"], "left", salt_by)
    named = F.col("matched").isNotNull() & F.col("_near").isNull()
    out = joined.withColumn("certainty", F.when(named, F.lit(1.0)).otherwise(F.col("certainty")))
    kept = [c for c in ingredients.columns if c != "embedding"]
    return out.select(*kept, "matched", "level", "groups", "certainty")


def level_rank(level: Column) -> Column:
    rank = F.lit(0)
    for name, value in LEVEL_RANK.items():
        rank = F.when(level == name, F.lit(value)).otherwise(rank)
    return rank


def product_rollup(matched: DataFrame) -> DataFrame:
    """Worst level and group union per product from matched rows (product, pos, ingredient, matched,
    level, groups); `pos` is an integer.

    Rows are first reduced per product and group, so a product of any size is pre-aggregated. What is
    collected in the end are its groups in order of first sight: at most the catalog's vocabulary.
    """
    known = F.col("matched").isNotNull()
    rows = matched.select(
        "product", "pos",
        F.when(known, level_rank(F.col("level"))).otherwise(F.lit(0)).alias("rank"),
        known.cast("long").alias("known"),
        F.posexplode_outer(F.when(known, F.col("groups"))).alias("at", "grp"),
    )
    # An ingredient with several groups spans rows: only the first of them counts it.
    counts = F.when(F.coalesce("at", F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0))
    per_group = rows.groupBy("product", "grp").agg(
        F.max("rank").alias("worst"),
        F.sum(counts).alias("n"),
        F.sum(counts * F.col("known")).alias("n_known"),
        F.min(F.struct(F.col("pos").cast("long").alias("pos"), "at")).alias("first"),
    )
    found = F.array_sort(F.collect_list(F.when(F.col("grp").isNotNull(), F.struct("first", "grp"))))
    totals = per_group.groupBy("product").agg(
        F.max("worst").alias("worst"), F.sum("n").alias("n_ingredients"),
        F.sum("n_known").alias("n_matched"), found.alias("found"),
    )
    worst = F.col("worst")
    overall = F.when(worst == 3, "high").when(worst == 2, "moderate").when(worst == 1, "low")
    return totals.select(
        "product", overall.alias("overall_level"),
        F.transform("found", lambda f: f["grp"]).alias("groups"),
        "n_ingredients", "n_matched", (F.col("n_ingredients") - F.col("n_matched")).alias("n_unknown"),
        F.when(overall.isNull(), F.lit("no ingredients matched the catalog")).alias("message"),
    )


def unknown_ingredients(matched: DataFrame) -> DataFrame:
    """Rows the catalog does not know, kept as rows however many a product has."""
    return matched.filter("matched IS NULL").select("product", "pos", "ingredient")


def products_without_ingredients(products: DataFrame, ingredients: DataFrame) -> DataFrame:
    """Answer rows for products that list nothing."""
    bare = products.select("product").distinct().join(ingredients.select("product"), "product", "left_anti")
    return bare.withColumn("message", F.lit("no ingredients found for product"))


# ---------------------------------------------------------------- product tags

def allergens(products: DataFrame) -> DataFrame:
    """(query, allergen, first): distinct allergens of the products found for a query (query, pos,
    allergens_tags), with the place of first sight."""
    tags = products.select("query", "pos", F.posexplode("allergens_tags").alias("at", "tag"))
    return tags.groupBy("query", strip_tag_locale(F.col("tag")).alias("allergen")).agg(
        F.min(F.struct("pos", "at")).alias("first")
    )


def product_ingredients(products: DataFrame) -> DataFrame:
    """Clean ingredient names per query of the first found product that lists any."""
    listed = products.filter(F.size("ingredients_tags") > 0)
    first = listed.groupBy("query").agg(F.min_by("ingredients_tags", "pos").alias("tags"))
    return first.select("query", ingredient_names("tags").alias("ingredients"))
