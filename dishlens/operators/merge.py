"""Keyed merges. Every merge is a join of a base table with a batch, so applying it twice changes
nothing more, and the result is a new snapshot."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dishlens.operators.dedup import latest_per_key
from dishlens.operators.spread import deal

Rule = str | Callable[[Column, Column], Column]

NEW, OLD, NEW_OR_OLD = "new", "old", "new_or_old"


def _combine(rule: Rule, new: Column, old: Column) -> Column:
    if callable(rule):
        return rule(new, old)
    return {NEW: new, OLD: old, NEW_OR_OLD: F.coalesce(new, old)}[rule]


def last_of_batch(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key of a batch: the last one in `order` wins, ties go by the other columns.

    The order is total but for columns that cannot be compared (maps, variants), so a task that
    runs again picks the same row.
    """
    rest = [
        f.name for f in batch.schema.fields
        if f.name not in (*keys, *order) and not re.search(r"\b(map<|variant)", f.dataType.simpleString())
    ]
    return latest_per_key(batch, keys, [F.col(c).desc_nulls_last() for c in (*order, *rest)])


def merge_upsert(
    base: DataFrame,
    batch: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, Rule] | None = None,
    default: Rule = NEW,
    on_insert: Mapping[str, Column] | None = None,
    on_update: Mapping[str, Column] | None = None,
    order: Sequence[str] = (),
    as_of: Column | None = None,
) -> DataFrame:
    """Insert the new keys of `batch` and combine the known ones column by column.

    The batch is first reduced to the last row of each key in `order` (see `last_of_batch`), so a key
    never doubles and no join partition can be hot; the reduction shares the join's shuffle.
    With `as_of`, `updated_at` moves on every touched row and `created_at` is set on new ones,
    where the base has these columns.
    `rules` says per column which side wins on a known key; a column the batch lacks keeps its
    base value. `on_insert` and `on_update` set columns from expressions, e.g. a default status
    or a change time.
    """
    rules, on_insert, on_update = dict(rules or {}), dict(on_insert or {}), dict(on_update or {})
    if as_of is not None:
        stamped = {c: as_of for c in ("created_at", "updated_at") if c in base.columns}
        on_insert = stamped | on_insert
        on_update = {c: as_of for c in stamped if c == "updated_at"} | on_update
    batch = last_of_batch(batch, keys, order)
    new = batch.withColumn("_in_batch", F.lit(True)).alias("new")
    old = base.withColumn("_in_base", F.lit(True)).alias("old")
    joined = old.join(new, list(keys), "full_outer")
    known = F.col("_in_base") & F.col("_in_batch")
    fresh = F.col("_in_base").isNull()
    columns = [F.col(k) for k in keys]
    for field in base.schema.fields:
        name = field.name
        if name in keys:
            continue
        before = F.col(f"old.{name}")
        if name in batch.columns:
            after = F.col(f"new.{name}").cast(field.dataType)
            changed = _combine(rules.get(name, default), after, before)
            inserted = on_insert[name] if name in on_insert else after
        else:
            changed = before
            inserted = on_insert.get(name, F.lit(None)).cast(field.dataType)
        if name in on_update:
            changed = on_update[name]
        columns.append(
            F.when(known, changed).when(fresh, inserted).otherwise(before)
            .cast(field.dataType).alias(name)
        )
    return joined.select(*columns).select(*base.columns)


def update_matched(
    base: DataFrame, batch: DataFrame, keys: Sequence[str], assign: Mapping[str, Column],
    order: Sequence[str] = (), as_of: Column | None = None,
) -> DataFrame:
    """UPDATE ... FROM: rows of `base` with a batch row get the assigned columns.

    Expressions see the base columns under `old` and the batch columns under `new`. Of repeated keys in
    the batch the last in `order` counts; with `as_of`, `updated_at` moves where the base has it.
    """
    if as_of is not None and "updated_at" in base.columns:
        assign = {"updated_at": as_of} | dict(assign)
    batch = last_of_batch(batch, keys, order)
    joined = base.alias("old").join(
        batch.withColumn("_hit", F.lit(True)).alias("new"), list(keys), "left"
    )
    columns = []
    for field in base.schema.fields:
        if field.name in keys:
            columns.append(F.col(field.name))
            continue
        before = F.col(f"old.{field.name}")
        if field.name in assign:
            before = F.when(F.col("_hit"), assign[field.name]).otherwise(before)
        columns.append(before.cast(field.dataType).alias(field.name))
    return joined.select(*columns).select(*base.columns)


def insert_absent(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the rows whose key is not known yet; known rows stay as they are."""
    fresh = batch.join(base.select(*keys), list(keys), "left_anti")
    return base.unionByName(fresh, allowMissingColumns=True)


def delete_keys(base: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Remove rows by key; an unknown key is no error."""
    return base.join(keys.select(*on), list(on), "left_anti")


def replace_children(
    children: DataFrame, parents: DataFrame, fresh: DataFrame, parent_key: str
) -> DataFrame:
    """Delete all children of the given parents, then add the new ones."""
    kept = children.join(parents.select(parent_key), parent_key, "left_anti")
    return kept.unionByName(fresh)


def _judged(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch with `_known`: whether the base has the key. One join."""
    return deal(batch, keys).join(base.select(*keys, F.lit(True).alias("_known")), list(keys), "left")


def strict_outcomes(base: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch with `create` and `update`: 'applied', or the reason why `strict_create` and `strict_update` reject the row."""
    known = F.col("_known").isNotNull()
    return _judged(base, batch, keys).select(
        *batch.columns, F.when(known, "conflict").otherwise("applied").alias("create"),
        F.when(known, "applied").otherwise("not found").alias("update"),
    )


def strict_create(
    base: DataFrame, batch: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(applied, rejected): a known key is a conflict. The base has each key at most once."""
    judged = _judged(base, batch, keys)
    known = judged.filter("_known").drop("_known")
    return judged.filter("_known IS NULL").select(*batch.columns), known.select(*batch.columns).withColumn("reason", F.lit("conflict"))


def strict_update(
    base: DataFrame, batch: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(applied, rejected): an unknown key is not found. The base has each key at most once."""
    judged = _judged(base, batch, keys)
    missing = judged.filter("_known IS NULL").select(*batch.columns).withColumn("reason", F.lit("not found"))
    return judged.filter("_known").select(*batch.columns), missing
