"""Best-fit decreasing packing of token sequences, exact over the whole table.

Pieces of equal length are alike to best-fit decreasing, so it runs on the histogram of lengths (at most
`capacity` rows, however large the table): a segment tree over remaining capacities finds the tightest
open bins, and all bins that look alike are filled in one step. The outcome is a list of runs: so many
pieces of one length, so many to a bin, from this bin on, at this offset. Pieces are numbered within
their length (in hash buckets, so that a frequent length is no single task) and look their run up.

Rows: null texts are empty and hold the end id alone; equal rows are packed as often as they occur; an empty
table packs to nothing; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import gapless, texts, written
from dishlens.llm.tokens import task_encoder


class CapacityTree:
    """Segment tree over capacities 0..top that knows which of them some open bin has left."""

    def __init__(self, top: int):
        self.size = 1 << max(1, top.bit_length())
        self.open = [0] * (2 * self.size)

    def mark(self, capacity: int, is_open: bool) -> None:
        at = capacity + self.size
        self.open[at] = int(is_open)
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity of at least `least`: climb to the first open subtree on the right, descend left."""
        at = least + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first, bin, per_bin, offset) and the number of bins.

    Piece number n of a length belongs to the last of the length's runs whose first is at most n; it is
    in bin + (n - first) // per_bin, at offset + (n - first) % per_bin * length.
    """
    tree, bins = CapacityTree(capacity), 0
    free: dict[int, list[tuple[int, int]]] = {}
    runs: list[tuple[int, int, int, int, int]] = []

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            free.setdefault(room, []).append((start, n))
            tree.mark(room, True)

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} with capacity {capacity}")
        done, total = 0, counts[length]
        while done < total:
            room = tree.tightest(length)
            if room is None:
                room, start, n = capacity, bins, -(-(total - done) // (capacity // length))
                bins += n
            else:
                start, n = free[room].pop()
                if not free[room]:
                    tree.mark(room, False)
            each = room // length
            full, left = min(n, (total - done) // each), 0
            if full < n and total - done - full * each < each:
                left = total - done - full * each
            runs.append((length, done, start, each, capacity - room))
            done += full * each + left
            leave(room - each * length, start, full)
            if left:
                leave(room - left * length, start + full, 1)
            rest = full + bool(left)
            leave(room, start + rest, n - rest)
    return runs, bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): whole texts encoded, cut only where longer than a sequence."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        with task_encoder(tokenizer) as ours:
            for batch in batches:
                doc, piece, start, length, crc = [], [], [], [], []
                found = (ids[a:b] for ids, bounds in ours.runs(batch.column("text")) for a, b in zip(bounds, bounds[1:]))
                for doc_id, encoded in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                    ids = np.concatenate([encoded.astype("<u4"), end])
                    for k in range(0, len(ids), capacity):
                        part = ids[k: k + capacity]
                        doc.append(doc_id)
                        piece.append(k // capacity)
                        start.append(k)
                        length.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, "int64"), pa.array(piece, "int32"), *(pa.array(x, "int64") for x in (start, length, crc))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return texts(docs).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long")


def packed(found: DataFrame, capacity: int, buckets: int = 256) -> DataFrame:
    """Add (sequence_id, offset) to a written table of pieces; `found` is read three times."""
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = best_fit_decreasing(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    span = np.int64(1) << np.int64(48)
    sent = found.sparkSession.sparkContext.broadcast((table[:, 0] * span + table[:, 1], table))
    numbered = gapless(found, ["length"], ["doc_id", "piece", "ids_crc32"], "rank", buckets)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, table = sent.value
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf.pop("rank").to_numpy(np.int64)
            run = table[np.searchsorted(keys, length * span + rank, "right") - 1]
            past = rank - run[:, 1]
            pdf["sequence_id"] = run[:, 2] + past // np.maximum(run[:, 3], 1)
            pdf["offset"] = run[:, 4] + past % np.maximum(run[:, 3], 1) * length
            yield pdf

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(assign, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096) -> DataFrame:
    """Pieces of all documents with their sequence and their place in it."""
    return packed(written(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
