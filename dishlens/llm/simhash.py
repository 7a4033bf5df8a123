"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `REACH` bits of each other are linked. The 64 bits are dealt into partitions so that
correlated bits share one; partition i gets a threshold t_i with sum(t_i) = REACH - partitions + 1, where
-1 leaves it out. Two fingerprints within REACH then differ in at most t_i bits of some partition i. The
thresholds come from a dynamic program on estimated candidate counts, taken from the value counts of all
fingerprints. Each fingerprint is entered under its partition's value with every choice of t_i bits blanked,
so candidates share a key, and they are verified on all 64 bits.

What leaves a group of equal keys is a spanning forest of its links, never its pairs: components need no
more. Groups above `GROUP` fingerprints are split into pairs of blocks that are checked in different tasks;
nothing is capped. Equal texts have equal fingerprints and are one node throughout.

Rows: a null or empty text has fingerprint zero and is linked like any other; null ids count only where a
component has no other id (its id is then null); repeated rows are kept. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dishlens.llm.common import texts, written

REACH, GROUP, BLOCKS, WIDTH = 3, 2048, 4, 16
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text: str, words: int = 3) -> int:
    """Majority bits of the XXH64 values (seed 42) of all word shingles; as a signed 64-bit integer."""
    found = _WORDS.findall(text.translate(_LOWER) if not text.isascii() else text.lower())
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) < words:
        shingles = iter([" ".join(found)])
    else:
        shingles = map(" ".join, zip(*[found[k:] for k in range(words)], strict=False))
    total, n = np.zeros(64, np.int64), 0
    while part := [digest(s, 42) for s in itertools.islice(shingles, 50_000)]:
        bits = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t) for t in pdf["text"]], np.int64),
            })

    return texts(docs).mapInPandas(run, "doc_id long, fp long")


# ---- partitions and thresholds -------------------------------------------------------------------


def _spread(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_order(classes: DataFrame) -> list[int]:
    """The 64 bits, correlated ones next to each other: from their joint counts over all fingerprints."""

    def joint(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((64, 64)), 0
        for pdf in batches:
            bits = _spread(pdf["fp"].to_numpy()).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        if n:
            at = np.indices((64, 64)).reshape(2, -1)
            yield pd.DataFrame({"a": at[0], "b": at[1], "both": both.ravel().astype(np.int64), "n": n})

    sums = classes.select("fp").mapInPandas(joint, "a int, b int, both long, n long").groupBy("a", "b").agg(
        F.sum("both").alias("both"), F.sum("n").alias("n")
    ).toPandas()
    if sums.empty:
        return list(range(64))
    both, n = np.zeros((64, 64)), float(sums["n"].iloc[0])
    both[sums["a"], sums["b"]] = sums["both"]
    mean = np.diag(both) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    tie = np.abs((both / n - np.outer(mean, mean)) / np.outer(spread, spread))
    left, order = set(range(64)), []
    while left:
        group = [min(left, key=lambda b: -max([tie[b, c] for c in left if c != b], default=0))]
        left -= set(group)
        while len(group) < WIDTH:
            best = min(left, key=lambda b: (-sum(tie[b, c] for c in group), b))
            group.append(best)
            left.discard(best)
        order += sorted(group)
    return order


def _reordered(fp: np.ndarray, order: list[int]) -> np.ndarray:
    """The fingerprints with bit order[i] moved to place i, unsigned."""
    moved = np.packbits(_spread(fp)[:, order], axis=1, bitorder="little")
    return np.ascontiguousarray(moved).view("<u8").ravel()


def _close_pairs(counts: np.ndarray, reach: int) -> list[float]:
    """Pairs of fingerprints whose 16-bit values differ in at most 0..reach bits, from the value counts."""
    at = [counts.astype(float)] + [np.zeros(1 << WIDTH) for _ in range(reach)]
    place = np.arange(1 << WIDTH)
    for bit in range(WIDTH):
        flipped = place ^ (1 << bit)
        at = [at[d] + (at[d - 1][flipped] if d else 0) for d in range(reach + 1)]
    exact = [float((counts * a).sum()) for a in at]
    return [max(0.0, (sum(exact[: d + 1]) - counts.sum()) / 2) for d in range(reach + 1)]


def allocate(costs: list[list[float]], reach: int) -> tuple[list[int], float]:
    """Thresholds of least total cost with sum reach - len(costs) + 1; costs[i][t + 1] is that of threshold t."""
    goal = reach + 1  # each threshold plus one
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, taken) in best.items():
            for share in range(min(len(row), goal - used + 1)):
                new = (cost + row[share], [*taken, share - 1])
                if used + share not in nxt or new < nxt[used + share]:
                    nxt[used + share] = new
        best = nxt
    return best[goal][1], best[goal][0]


def plan(classes: DataFrame, order: list[int]) -> list[tuple[int, int, int]]:
    """(first place, width, threshold) of the partitions used, places being those of the reordered bits."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((BLOCKS, 1 << WIDTH), np.int64)
        for pdf in batches:
            moved = _reordered(pdf["fp"].to_numpy(), order).view("<u2").reshape(-1, BLOCKS)
            for b in range(BLOCKS):
                sums[b] += np.bincount(moved[:, b], minlength=1 << WIDTH)
        b, v = np.nonzero(sums)
        yield pd.DataFrame({"b": b, "v": v, "n": sums[b, v]})

    found = classes.select("fp").mapInPandas(count, "b int, v int, n long").groupBy("b", "v").agg(
        F.sum("n").alias("n")
    ).toPandas()  # at most 4 x 65,536 rows
    counts = np.zeros((BLOCKS, 1 << WIDTH))
    counts[found["b"], found["v"]] = found["n"]
    return choose(counts)


def choose(counts: np.ndarray) -> list[tuple[int, int, int]]:
    """The cheapest partitioning into runs of 16-bit blocks with its thresholds.

    A key costs 20 times a candidate pair (it is shuffled and sorted). A run's candidates are estimated
    from its blocks as if they were independent.
    """
    n = max(float(counts[0].sum()), 1.0)
    pairs, near = n * n / 2, [_close_pairs(c, REACH) for c in counts]
    best = None
    for cuts in itertools.product((False, True), repeat=BLOCKS - 1):
        runs, start = [], 0
        for b in range(1, BLOCKS + 1):
            if b == BLOCKS or cuts[b - 1]:
                runs.append((start, b))
                start = b
        costs = []
        for a, b in runs:
            share = [1.0] + [0.0] * REACH
            for k in range(a, b):
                exact = np.diff([0.0, *near[k]]) / pairs
                share = [sum(share[i] * exact[d - i] for i in range(d + 1)) for d in range(REACH + 1)]
            width = (b - a) * WIDTH
            costs.append([0.0] + [
                20 * n * comb(width, t) + pairs * sum(share[: t + 1]) * comb(width, t) for t in range(REACH + 1)
            ])
        thresholds, cost = allocate(costs, REACH)
        if best is None or cost < best[0]:
            best = (cost, [(a * WIDTH, (b - a) * WIDTH, t) for (a, b), t in zip(runs, thresholds, strict=True) if t >= 0])
    return best[1]


# ---- candidates and verification -----------------------------------------------------------------


def candidate_keys(classes: DataFrame, order: list[int], partitions: list[tuple[int, int, int]]) -> DataFrame:
    """(part, key, fp): part tells the partition and the blanked bits, key the other bits' value."""
    masks = []
    for first, width, threshold in partitions:
        whole = ((1 << width) - 1) << first
        for blank in itertools.combinations(range(first, first + width), threshold):
            masks.append(whole & ~sum(1 << b for b in blank))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy()
            moved = _reordered(fp, order)
            for part, mask in enumerate(masks):
                yield pd.DataFrame({"part": np.int32(part), "key": (moved & np.uint64(mask)).view("<i8"), "fp": fp})

    return classes.select("fp").mapInPandas(keys, "part int, key long, fp long")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place reachable from each of n places over the links a-b."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _spanning(group: np.ndarray, side: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smallest fp of its component) within runs of equal `group`; sides 1 and 2 meet only each other."""
    if len(fp) < 2:
        return fp[:0], fp[:0]
    rank = np.lexsort((fp, group))
    group, side, fp = group[rank], side[rank], fp[rank]
    bits = fp.view("<u8")
    end = np.searchsorted(group, group, "right")
    at, a, b, held = np.arange(len(fp)), [], [], 0
    step, low = 1, np.arange(len(fp))
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            break
        near = np.bitwise_count(bits[at] ^ bits[at + step]) <= REACH
        hit = at[near]
        hit = hit[(side[hit] == 0) | (side[hit] != side[hit + step])]
        a.append(hit)
        b.append(hit + step)
        held += len(hit)
        if held > 1_000_000:
            low = _forest(len(fp), np.concatenate([*a, np.arange(len(fp))]), np.concatenate([*b, low]))
            a, b, held = [], [], 0
        step += 1
    low = _forest(len(fp), np.concatenate([*a, np.arange(len(fp))]).astype(np.int64), np.concatenate([*b, low]).astype(np.int64))
    moved = low != np.arange(len(fp))
    return fp[moved], fp[low[moved]]


def _links_of_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (part, key, blocks); a run that a batch cuts is carried over. Runs are of at most 2 GROUP."""
    names = ["part", "key", "x", "y"]
    carried = None
    for pdf in batches:
        if carried is not None:
            pdf = pd.concat([carried, pdf], ignore_index=True)
        last = (pdf[names] == pdf[names].iloc[-1]).all(axis=1).to_numpy()
        carried, pdf = pdf[last], pdf[~last]
        yield from _linked(pdf, names)
    if carried is not None:
        yield from _linked(carried, names)


def _linked(pdf: pd.DataFrame, names: list[str]) -> Iterator[pd.DataFrame]:
    if len(pdf) > 1:
        columns = pdf[names].to_numpy()
        group = np.concatenate([[0], np.cumsum((columns[1:] != columns[:-1]).any(axis=1))])
        a, b = _spanning(group, pdf["side"].to_numpy(), pdf["fp"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def links(classes: DataFrame) -> DataFrame:
    """(a, b): a spanning forest's links, for each key group, between different fingerprints; b is the smaller one."""
    order = bit_order(classes)
    keys = candidate_keys(classes, order, plan(classes, order))
    large = keys.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP)
    blocks = F.ceil(F.col("n") / GROUP).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    dealt = keys.join(large, ["part", "key"], "left").withColumn("own", F.coalesce(own, F.lit(0)))
    other = F.when(F.col("n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1))
    dealt = dealt.withColumn("other", F.explode(other)).select(
        "part", "key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
        # within one block all meet; of two blocks each meets the other
        F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    names = ["part", "key", "x", "y"]
    return dealt.repartition(*names).sortWithinPartitions(*names).mapInPandas(_links_of_runs, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, low): the smallest node reachable, for every node with a link. Alternating stars until nothing moves.

    A round sends every node's larger neighbours to the smallest node it knows, then each node and its other
    smaller neighbours to the smallest of them. It ends when every node has one smaller neighbour and that one
    has none; rounds are written to the shared folder.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        again = edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").select("a")
        inner = edges.join(edges.select(F.col("b").alias("_b")), F.col("a") == F.col("_b"), "left_semi").select("a")
        if not again.unionByName(inner).take(1):
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("low"))
        large = edges.join(low, edges["b"] == low["n"]).select("a", F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("b"))
        small = large.withColumnRenamed("b", "c").join(least, "a").filter("c != b").select(F.col("c").alias("a"), "b")
        edges = written(least.unionByName(small).distinct(), "links")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("low"))
    return stars.unionByName(stars.select(F.col("low").alias("node"), "low").distinct())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row."""
    found = written(fingerprints(docs), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    reached = components(links(classes))
    joined = classes.join(reached, classes["fp"] == reached["node"], "left").select(
        "fp", "first", F.coalesce("low", "fp").alias("low")
    )
    named = joined.join(joined.groupBy("low").agg(F.min("first").alias("component_id")), "low").select("fp", "component_id")
    return found.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document of each component: that of the smallest id, once.

    Rows without an id cannot be told apart and stay.
    """
    kept = near_duplicates(docs).select(F.col("component_id").alias("_kept")).filter("_kept IS NOT NULL").distinct()
    given = docs.filter(F.col("doc_id").isNotNull())
    chosen = given.join(kept.hint("merge"), given["doc_id"] == kept["_kept"], "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))
    once = chosen.withColumn("_first", first).filter("_first = 1").select(*docs.columns)
    return once.unionByName(docs.filter(F.col("doc_id").isNull()))
