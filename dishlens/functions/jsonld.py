"""Menus and restaurant facts from schema.org JSON-LD, entirely inside the JVM (VARIANT)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dishlens import constants as K
from dishlens.operators.spread import let

# A comment is taken as one match so that scripts inside it are not seen.
_COMMENT_OR_SCRIPT = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>"
_LD_SCRIPT = r"""(?is)^<script\b[^>]*?\stype\s*=\s*(?:"application/ld\+json"|'application/ld\+json'|application/ld\+json)[\s>/]"""
_LD_SCRIPT_END = r"""(?is)^<script\b[^>]*?\stype\s*=\s*(?:"application/ld\+json"|'application/ld\+json')>"""
_NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"

ITEM = (
    "STRUCT<dish_name: STRING, description: STRING, price: DOUBLE, "
    "stated_ingredients: ARRAY<STRING>, has_full_ingredients: BOOLEAN>"
)


def ld_blocks(html: Column | str) -> Column:
    """Bodies of the JSON-LD scripts of a page, in order."""
    html = F.col(html) if isinstance(html, str) else html
    found = F.regexp_extract_all(html, F.lit(_COMMENT_OR_SCRIPT), F.lit(0))
    scripts = F.filter(found, lambda m: m.rlike(_LD_SCRIPT) | m.rlike(_LD_SCRIPT_END))
    return F.transform(
        scripts, lambda m: F.regexp_replace(m, r"(?is)^<script\b[^>]*>|</script\s*>$", "")
    )


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT")


def _list(value: Column, path: str) -> Column:
    """Array at a path; empty when absent or not an array."""
    return F.coalesce(
        F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>")
    )


def _text(value: Column, path: str) -> Column:
    """String at a path; NULL when absent or of another type."""
    leaf = F.try_variant_get(value, path, "variant")
    return F.when(_kind(leaf) == "STRING", F.try_variant_get(value, path, "string"))


def _strings(value: Column, path: str) -> Column:
    """String elements of an array, or a lone string as one element."""
    elements = F.try_variant_get(value, path, "array<variant>")
    kept = F.transform(
        F.filter(elements, lambda e: _kind(e) == "STRING"),
        lambda e: F.try_variant_get(e, "$", "string"),
    )
    lone = _text(value, path)
    return F.coalesce(kept, F.when(lone.isNotNull(), F.array(lone)))


def _price(item: Column) -> Column:
    leaf = F.try_variant_get(item, "$.offers.price", "variant")
    kind = _kind(leaf)
    text = F.trim(F.try_variant_get(item, "$.offers.price", "string"))
    number = F.try_variant_get(item, "$.offers.price", "double")
    return F.when(kind == "STRING", F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))).when(
        kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)"), number
    )


def _entry(item: Column) -> Column:
    """Menu entry of a MenuItem node."""
    has_list = F.try_variant_get(item, "$.ingredients", "variant").isNotNull()
    ingredients = F.coalesce(
        F.when(has_list, _strings(item, "$.ingredients")).otherwise(
            _strings(item, "$.recipeIngredient")
        ),
        F.array().cast("array<string>"),
    )
    return F.struct(
        _text(item, "$.name").alias("dish_name"),
        F.coalesce(_text(item, "$.description"), F.lit("")).alias("description"),
        _price(item).alias("price"),
        ingredients.alias("stated_ingredients"),
        (F.size(ingredients) > 0).alias("has_full_ingredients"),
    )


def _named(items: Column) -> Column:
    return F.filter(items, lambda i: F.coalesce(_text(i, "$.name"), F.lit("")) != "")


def _menu_items(menu: Column) -> Column:
    """Item nodes of a menu: those of its sections first, then its own."""
    sections = _list(menu, "$.hasMenuSection")
    nested = F.flatten(F.transform(sections, lambda s: _list(s, "$.hasMenuItem")))
    return F.concat(nested, _list(menu, "$.hasMenuItem"))


def nodes(block: Column) -> Column:
    """Object nodes of one JSON-LD block: its @graph, its array elements, or the object itself."""

    def listed(value: Column) -> Column:
        return F.coalesce(
            F.try_variant_get(value, "$['@graph']", "array<variant>"),
            F.try_variant_get(value, "$", "array<variant>"),
            F.when(value.isNotNull(), F.array(value)),
            F.array().cast("array<variant>"),
        )

    return F.filter(let(F.try_parse_json(block), listed), _is_object)


def _node_items(node: Column) -> Column:
    kind = _text(node, "$['@type']")
    menu = F.try_variant_get(node, "$.hasMenu", "variant")
    return (
        F.when(kind.isin(K.RESTAURANT_TYPES), _menu_items(menu))
        .when(kind == "Menu", _menu_items(node))
        .when(kind == "MenuItem", F.array(node))
        .otherwise(F.array().cast("array<variant>"))
    )


def _node_meta(node: Column) -> Column:
    """Restaurant facts of a node; blank for nodes of other types."""
    fits = _text(node, "$['@type']").isin(K.RESTAURANT_TYPES)

    def fact(path: str) -> Column:
        return F.coalesce(F.when(fits, _text(node, path)), F.lit(""))

    return F.struct(
        fact("$.name").alias("restaurant_name"),
        fact("$.address.addressLocality").alias("city"),
        fact("$.address.addressRegion").alias("state"),
    )


def with_jsonld(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Add `items` (array of menu entries), `meta` (restaurant facts) and `jsonld_hit`.

    Pages without the script type never reach the JSON parser.
    """
    blocks = F.when(F.col(html_col).rlike(r"(?i)application/ld\+json"), ld_blocks(html_col)).otherwise(
        F.array().cast("array<string>")
    )
    named = F.filter(F.col("_metas"), lambda m: m["restaurant_name"] != "")
    blank = F.struct(*[F.lit("").alias(c) for c in ("restaurant_name", "city", "state")])
    return (
        df.withColumn("_nodes", F.flatten(F.transform(blocks, nodes)))
        .withColumn("_metas", F.transform("_nodes", _node_meta))
        .withColumn(
            "items",
            F.transform(_named(F.flatten(F.transform("_nodes", _node_items))), _entry),
        )
        .withColumn(
            "meta", F.coalesce(F.get(named, F.lit(0)), F.try_element_at("_metas", F.lit(-1)), blank)
        )
        .withColumn("jsonld_hit", F.size("items") > 0)
        .drop("_nodes", "_metas")
    )
