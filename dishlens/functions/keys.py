"""Deterministic identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dishlens.constants import NS_MENU_ITEM, NS_OID, NS_REGULATORY, NS_URL


def uuid5(namespace: str, name: Column | str) -> Column:
    """Name-based UUID (version 5): SHA-1 over namespace bytes and UTF-8 name, bits set in place."""
    name = F.col(name) if isinstance(name, str) else name
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "UTF-8")))
    # The variant keeps the two low bits of its digit and sets the high bits to 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def review_key(review_id: Column | str) -> Column:
    return uuid5(NS_OID, review_id)


def chunk_key(review_id: Column, chunk_ix: Column) -> Column:
    return uuid5(NS_OID, F.concat(review_id, F.lit("_chunk_"), chunk_ix.cast("string")))


def catalog_key(ingredient: Column, prefix: str) -> Column:
    """Key of a catalog vector; `prefix` names the catalog and ends up inside the hashed name."""
    return uuid5(NS_OID, F.concat(F.lit(prefix), ingredient))


def menu_item_key(business_id: Column, section: Column, dish: Column) -> Column:
    return uuid5(NS_MENU_ITEM, F.concat_ws("|", business_id, section, dish))


def source_key(domain: Column | str) -> Column:
    return uuid5(NS_URL, domain)


def rule_key(domain: Column, selector: Column) -> Column:
    return uuid5(NS_URL, F.concat(domain, selector))


def regulatory_key(source_id: Column, day: Column, cas: Column, substance: Column) -> Column:
    """Table key: one row per source, day and substance."""
    return uuid5(NS_URL, F.concat(source_id, day, cas, substance))


def regulatory_vector_key(source_id: Column, cas: Column, substance: Column) -> Column:
    """Vector key: has no day, so later days overwrite; nested in its own namespace."""
    return uuid5(NS_REGULATORY, uuid5(NS_URL, F.concat(source_id, cas, substance)))
