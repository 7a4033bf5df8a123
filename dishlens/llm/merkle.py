"""Document fingerprints: a Merkle tree over sections, paragraphs and clauses.

A text is cut into paragraphs (lines), and paragraphs into clauses of at most `LONGEST` code points. A section ends at a
blank line, and behind a paragraph whose hash says so, one in `SECTION`: such ends depend on the paragraph alone, so an edit
moves no section but its own. A clause's hash is that of its characters, every other node's that of its children's
hashes, so two roots are equal exactly where the texts are. `compare` descends from the roots: children of equal hash
are matched in order and never opened; those between two matches are paired in order and opened level by
level. Where one clause alone differs in its paragraph, its pieces of up to `PIECE` code points are matched as well.
The likeness is the share of code points in matched branches, and every branch without a match is an edit.

Rows: null texts are empty; the tree of the empty text has a root and no branch. Documents follow each other by
ascending id, nulls first, equal ids in the order of their texts' hashes, so that many rows without an id are dealt into
many tasks; equal texts have equal fingerprints. Very long texts are
read whole, one at a time. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import range_splits, texts

LONGEST, SECTION, PIECE = 96, 8, 4
_CLAUSE = re.compile(rf"[^.,;:!?]{{1,{LONGEST}}}[.,;:!?]*|[.,;:!?]+", re.DOTALL)
_PIECE = re.compile(rf"\w{{1,{PIECE}}}|\W", re.DOTALL)

#: A node: hash, code points below it, its children; a clause has its characters instead.
Node = tuple[bytes, int, tuple | str]
Path = tuple[int, ...]


def _parent(children: list[Node]) -> Node:
    digest = hashlib.blake2b(b"".join([c[0] for c in children]), digest_size=16, person=b"branch").digest()
    return digest, sum([c[1] for c in children]), tuple(children)


def _leaf(text: str) -> Node:
    return hashlib.blake2b(text.encode(), digest_size=16).digest(), len(text), text


def _paragraph(line: str) -> Node:
    return _parent([_leaf(c) for c in _CLAUSE.findall(line)])


def tree(text: str) -> Node:
    sections: list[Node] = []
    held: list[Node] = []
    blank = True
    for line in text.splitlines(keepends=True):
        if held and not blank and line == "\n":
            sections.append(_parent(held))
            held = []
        blank = line == "\n"
        held.append(_paragraph(line))
        if held[-1][0][0] < 256 // SECTION and not blank:
            sections.append(_parent(held))
            held = []
    if held:
        sections.append(_parent(held))
    return _parent(sections)


def _children(node: Node) -> tuple[Node, ...]:
    if isinstance(node[2], tuple):
        return node[2]
    return tuple([_leaf(p) for p in _PIECE.findall(node[2])])


def matched(a: Sequence[Node], b: Sequence[Node]) -> list[tuple[int, int]]:
    """Positions of children of equal hash, in order: what both begin and end with, and between these the longest
    order of children that each side has once; the same again between two of them."""
    left, right = [n[0] for n in a], [n[0] for n in b]
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and left[m - 1] == right[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once, there = Counter(left[i:m]), Counter(right[j:n])
        place = {h: k for k, h in enumerate(right[j:n], j) if there[h] == 1}
        common = [(k, place[h]) for k, h in enumerate(left[i:m], i) if once[h] == 1 and h in place]
        anchors = _rising(common)
        ends = [*anchors, (m, n)]
        for p, q in ends if anchors else ():
            todo.append((i, p, j, q))
            i, j = p + 1, q + 1
        out += anchors
    return sorted(out)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, sorted by their first numbers, whose second numbers rise too."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(tails, q)
        before.append(at[n - 1] if n else -1)
        tails[n:n + 1], at[n:n + 1] = [q], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def compare(a: Node, b: Node) -> tuple[int, list[Path], int]:
    """(code points in matched branches, edits, nodes looked at) of two trees.

    Edits are branch numbers (section, paragraph, clause, piece) in the first tree of all branches without a match,
    the highest each; where only the second tree has more, the place where it has.
    """
    if a[0] == b[0]:
        return a[1], [], 1
    same, edits, seen = 0, [], 1
    todo: list[tuple[Node, Node, Path]] = [(a, b, ())]
    while todo:
        x, y, path = todo.pop()
        left, right = _children(x), _children(y)
        seen += len(left) + len(right)
        pairs = matched(left, right)
        same += sum([left[i][1] for i, _ in pairs])
        gaps, i, j = [], 0, 0
        for p, q in [*pairs, (len(left), len(right))]:
            if i < p or j < q:
                gaps.append((i, p, j, q))
            i, j = p + 1, q + 1
        alone = len(gaps) == 1 and gaps[0][1] - gaps[0][0] == 1 and gaps[0][3] - gaps[0][2] == 1
        for i, p, j, q in gaps:
            for k in range(i, p):
                other = right[j + k - i] if j + k - i < q else None
                deeper = other is not None and isinstance(left[k][2], tuple) == isinstance(other[2], tuple)
                if deeper and (isinstance(left[k][2], tuple) or (alone and len(path) == 2)):
                    todo.append((left[k], other, (*path, k)))
                else:
                    edits.append((*path, k))
            if q - j > p - i:
                edits.append((*path, p))
    return same, sorted(edits), seen


def likeness(a: Node, b: Node) -> float:
    """Share of code points in matched branches, of the longer text; 1 for equal roots, also of empty texts."""
    return 1.0 if a[0] == b[0] else compare(a, b)[0] / max(a[1], b[1], 1)


def first_difference(a: Node, b: Node) -> Path:
    """Branch numbers that lead to the first edit; empty for equal texts."""
    edits = compare(a, b)[1]
    return edits[0] if edits else ()


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many (or all) of the next text's first."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, sections int, edits array<array<int>>"
)


def document_fingerprints(docs: DataFrame, docs_per_range: int = 2_000, most: int = 8192) -> DataFrame:
    """Fingerprint every text and its edited text and compare the trees, also with the next document's.

    Documents are dealt once, into ranges of ids; the first document of a range also goes to the range
    before it (that of the first range to the last), as its last document's successor.
    """
    # of 52 bits, which the percentiles behind the cuts keep exactly
    rows = texts(docs).withColumn("_hash", F.shiftrightunsigned(F.xxhash64("text"), 12))
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL")
    unnamed = rows.filter("doc_id IS NULL").select(F.col("_hash").alias("doc_id"))
    cuts, low_cuts = (range_splits(x, min(most, -(-x.count() // docs_per_range))) for x in (ids, unnamed))
    # documents without an id come first, in ranges of their texts' hashes
    starts, low_starts, low = np.array(cuts, np.int64), np.array(low_cuts, np.int64), len(low_cuts)
    n = max(1, len(cuts) + low)

    @F.pandas_udf("int")
    def range_of(doc_id: pd.Series, given: pd.Series, text_hash: pd.Series) -> pd.Series:
        by_id = np.searchsorted(starts, doc_id.to_numpy(np.int64), "right") - 1 + low
        by_hash = np.searchsorted(low_starts, text_hash.to_numpy(np.int64), "right") - 1
        return pd.Series(np.where(given.to_numpy(bool), by_id, by_hash).astype(np.int32))

    head = F.col("doc_id").isin(cuts) if cuts else F.lit(False)
    low_head = F.col("_hash").isin(low_cuts) if low_cuts else F.lit(False)
    first = F.when(F.col("doc_id").isNull(), low_head).otherwise(head)
    own = F.struct(F.col("_range").alias("to"), F.lit(False).alias("ahead"))
    ahead = F.struct(F.pmod(F.col("_range") - 1, F.lit(n)).alias("to"), F.lit(True).alias("ahead"))
    # heads that share an id or a hash also share the range, and only the first of them is used there
    dealt = rows.withColumn("_range", range_of(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), F.col("_hash"))).withColumn(
        "_to", F.explode(F.when(first, F.array(own, ahead)).otherwise(F.array(own)))
    ).select(F.col("_to.to").alias("to"), F.col("_to.ahead").alias("ahead"), "doc_id", "text", "_hash")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            out = []
            for to, is_ahead, doc_id, text, _ in pdf.itertuples(index=False, name=None):
                if held is None and is_ahead:
                    continue
                here = tree(text)
                if held is not None:
                    out.append(_row(*held, text, here))
                held = None if is_ahead else (doc_id, text, here)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"doc_id": "Int64"})

    return (
        dealt.repartitionById(n, F.col("to")).sortWithinPartitions("ahead", F.asc_nulls_first("doc_id"), "_hash", "text")
        .mapInPandas(compare, SCHEMA)
    )


def _row(doc_id, text: str, own: Node, following: str, after: Node) -> tuple:
    new = edited(text, following)
    other = tree(new)
    same, edits, _ = compare(own, other)
    return (
        None if pd.isna(doc_id) else int(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), own[0].hex(), other[0].hex(),
        1.0 if own[0] == other[0] else same / max(own[1], other[1], 1), likeness(own, after), len(own[2]), [list(e) for e in edits],
    )
