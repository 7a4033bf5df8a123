"""Sharding by a weighted hash tree: regions, racks and shards, one weighted hash draw per level.

At each level a row draws once for every child, -ln(u) / weight with u a hash of its id and the child's
name, and descends into the child with the smallest draw. A child's draw depends on nothing but its
own name and weight, so when a weight changes rows move only into or out of the subtrees whose
weights changed; everything else stays. A shard added as a subtree of its own (`grown`) only takes rows.

Rows: a null id draws like any other value, so all of them share a shard. Equal ids share a shard.
Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import gapless

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def balanced(shards: int, racks: int = 4, per_rack: int = 4, per_region: int = 2) -> Tree:
    """Shards 0.. of weight 1, `per_rack` to a rack and `per_region` racks to a region."""
    if shards != racks * per_rack or racks % per_region:
        raise ValueError("shards must fill the racks, and racks the regions")
    return {
        f"region{r // per_region}": {
            f"rack{k}": {k * per_rack + s: 1.0 for s in range(per_rack)}
            for k in range(r, r + per_region)
        }
        for r in range(0, racks, per_region)
    }


def grown(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own: only the root gets another child."""
    if any(shard in leaves for racks in tree.values() for leaves in racks.values()):
        raise ValueError(f"shard {shard} is there already")
    return tree | {f"region+{shard}": {f"rack+{shard}": {shard: weight}}}


def _weight(node: dict | float) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _drawn(key: Column, children: dict, path: str) -> Column:
    """Position of the child with the smallest draw among those of positive weight."""
    draws = []
    for at, (name, child) in enumerate(children.items()):
        weight = _weight(child)
        if weight > 0:
            bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{path}/{name}")), 11)
            uniform = (bits.cast("double") + 0.5) * F.lit(2.0**-53)
            draws.append(F.struct((-F.ln(uniform) / weight).alias("draw"), F.lit(at).alias("at")))
    if not draws:
        raise ValueError(f"no child of {path or 'the root'} has a weight")
    return F.array_min(F.array(*draws))["at"] if len(draws) > 1 else draws[0]["at"]


def placed(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Add the shard of each row: one column per level, then only the shard is kept."""
    region, rack = f"_{name}_region", f"_{name}_rack"
    regions = list(tree)
    df = df.withColumn(region, _drawn(F.col(key), tree, ""))
    level, leaf = None, None
    for r, at in enumerate(regions):
        if _weight(tree[at]) <= 0:
            continue
        here = _drawn(F.col(key), tree[at], f"/{at}")
        level = F.when(F.col(region) == r, here) if level is None else level.when(F.col(region) == r, here)
        for k, (rack_name, leaves) in enumerate(tree[at].items()):
            if _weight(leaves) <= 0:
                continue
            numbers = F.array(*[F.lit(int(n)) for n in leaves])
            shard = F.get(numbers, _drawn(F.col(key), leaves, f"/{at}/{rack_name}"))
            found = (F.col(region) == r) & (F.col(rack) == k)
            leaf = F.when(found, shard) if leaf is None else leaf.when(found, shard)
    return df.withColumn(rack, level).withColumn(name, leaf).drop(region, rack)


def shard_documents(docs: DataFrame, tree: Tree, one_more: int, buckets: int = 1024) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row of a documents table.

    size: UTF-8 bytes of the text plus 1; a null text has size 1 and the checksum of the empty text.
    slot: gapless from 0 within a shard, by id; rows with equal id, size and checksum in any order.
    grown_shard: the shard after `one_more` has been added. Texts are read, never shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = placed(placed(rows, "doc_id", tree, "shard"), "doc_id", grown(tree, one_more), "grown_shard")
    return gapless(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot", buckets).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
