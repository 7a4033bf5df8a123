"""Token ids as binary output: wavelet matrices in one compressed file per shard.

A shard is a range of document ids. Its file holds its documents in ascending id order, cut into blocks
of about `BLOCK` tokens; a block is one row: the documents' ids and lengths, and the wavelet matrix of
their tokens, 16 bit-planes with the number of zeros of each plane and a rank directory. Access, counting
and occurrence look-up read only a block's planes; `decoded` undoes all of them.

The file is Parquet, because Spark can write and read it on any shared store and it compresses planes.

Rows: null texts are empty documents (they hold the end id alone); null ids come first; documents with equal
ids stay apart, ordered by their tokens. An empty table makes no file rows. Extra columns are ignored.
A document longer than a block makes a block of its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dishlens.llm.common import folder, range_splits, texts
from dishlens.llm.tokens import task_encoder

BITS, BLOCK, STRIDE = 16, 1 << 21, 512
#: More shards than this would make the list of range starts long; shards then grow, blocks don't.
MAX_SHARDS = 8192

SCHEMA = (
    "shard int, block int, n_tokens long, doc_ids array<long>, lengths array<long>, "
    "zeros array<long>, planes array<binary>, ranks array<binary>"
)


class WaveletMatrix:
    """Sequence of 16-bit ids with access, rank (count of an id before a place) and select (place of an occurrence)."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], ranks: list[bytes]):
        self.n, self.zeros = n, [int(z) for z in zeros]
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        level, zeros, planes, ranks = ids.astype(np.uint16), [], [], []
        for b in reversed(range(BITS)):
            ones = ((level >> np.uint16(b)) & np.uint16(1)).astype(bool)
            packed = np.packbits(ones)
            count = np.bitwise_count(np.pad(packed, (0, -len(packed) % (STRIDE // 8)))).reshape(-1, STRIDE // 8)
            sums = np.concatenate([[0], np.cumsum(count.sum(1, dtype=np.int64))])
            level = np.concatenate([level.compress(~ones), level.compress(ones)])
            zeros.append(len(ids) - int(sums[-1]))
            planes.append(packed.tobytes())
            ranks.append(sums.astype("<u4").tobytes())
        return cls(len(ids), zeros, planes, ranks)

    def _ones(self, plane: int, at: int) -> int:
        """Ones of a plane before a place: the directory's count plus those since."""
        block = at // STRIDE
        bits = self.planes[plane][block * STRIDE // 8: (at + 7) // 8]
        rest = int(np.bitwise_count(bits).sum())
        if at % 8:
            rest -= int(bits[-1] & ((1 << (8 - at % 8)) - 1)).bit_count()
        return int(self.ranks[plane][block]) + rest

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane][at // 8]) >> (7 - at % 8) & 1

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        value = 0
        for p in range(BITS):
            bit, ones = self._bit(p, at), self._ones(p, at)
            at = self.zeros[p] + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, at: int) -> tuple[int, int]:
        """Where the token's run starts on the last level, and where its occurrences before `at` end."""
        low, high = 0, at
        for p in range(BITS):
            a, b = self._ones(p, low), self._ones(p, high)
            if token >> (BITS - 1 - p) & 1:
                low, high = self.zeros[p] + a, self.zeros[p] + b
            else:
                low, high = low - a, high - b
        return low, high

    def rank(self, token: int, at: int) -> int:
        """Occurrences of the token before place `at`."""
        low, high = self._range(token, min(at, self.n))
        return high - low

    def select(self, token: int, k: int) -> int | None:
        """Place of the token's k-th occurrence, from 0; None if there are fewer."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            return None
        at = low + k
        for p in reversed(range(BITS)):
            one = token >> (BITS - 1 - p) & 1
            at = self._find(p, at - self.zeros[p] if one else at, one)
        return at

    def _find(self, plane: int, k: int, one: int) -> int:
        """Place of the k-th one (or zero) of a plane: halve the directory, then one stride."""
        sums = self.ranks[plane].astype(np.int64)
        before = sums if one else np.arange(len(sums), dtype=np.int64) * STRIDE - sums
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[plane][block * STRIDE // 8: (block + 1) * STRIDE // 8])
        bits = bits[: self.n - block * STRIDE]
        return block * STRIDE + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def decoded(self) -> np.ndarray:
        """All ids: from the last level up, each plane says where a value of the next level came from."""
        values = np.zeros(self.n, np.uint16)
        for p in reversed(range(BITS)):
            ones = np.unpackbits(self.planes[p], count=self.n).astype(bool)
            above = np.empty_like(values)
            above[np.flatnonzero(~ones)] = values[: self.zeros[p]]
            above[np.flatnonzero(ones)] = values[self.zeros[p]:] | np.uint16(1 << (BITS - 1 - p))
            values = above
        return values


def _row(shard: int, block: int, doc_ids: list, parts: list[np.ndarray]) -> pd.DataFrame:
    matrix = WaveletMatrix.build(np.concatenate(parts))
    return pd.DataFrame({
        "shard": [shard], "block": [block], "n_tokens": [matrix.n], "doc_ids": [doc_ids],
        "lengths": [[len(p) for p in parts]], "zeros": [matrix.zeros],
        "planes": [[p.tobytes() for p in matrix.planes]], "ranks": [[r.tobytes() for r in matrix.ranks]],
    })


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, docs_per_shard: int = 2_000) -> None:
    """Encode whole texts, append the end id to each and write one compressed file per range of ids.

    Texts are encoded where they are read; only token ids are shuffled, once, straight to their shard.
    """
    rows = texts(docs)
    ids = rows.select("doc_id")
    cuts = np.array(range_splits(ids, min(MAX_SHARDS, -(-ids.count() // docs_per_shard))), np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u2").tobytes()
        with task_encoder(tokenizer) as ours:
            for batch in batches:
                at = 0
                for ids, bounds in ours.runs(batch.column("text")):
                    doc_ids = batch.column("doc_id").slice(at, len(bounds) - 1)
                    given = doc_ids.is_valid().to_numpy(zero_copy_only=False)
                    number = doc_ids.fill_null(0).to_numpy(zero_copy_only=False)
                    shard = np.where(given, np.maximum(np.searchsorted(cuts, number, "right") - 1, 0), 0)
                    found = [ids[a:b].tobytes() + end for a, b in zip(bounds, bounds[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids, pa.array(shard, "int32"), pa.array(found, "binary")], ["doc_id", "shard", "ids"]
                    )
                    at += len(found)

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, block, size, doc_ids, parts = None, 0, 0, [], []
        for pdf in batches:
            for to, doc_id, ids in zip(pdf["shard"], pdf["doc_id"], pdf["ids"], strict=True):
                if parts and (to != shard or size >= BLOCK):
                    yield _row(shard, block, doc_ids, parts)
                    block, size, doc_ids, parts = block + 1, 0, [], []
                if to != shard:
                    shard, block = to, 0
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                parts.append(np.frombuffer(ids, "<u2"))
                size += len(parts[-1])
        if parts:
            yield _row(shard, block, doc_ids, parts)

    dealt = rows.mapInArrow(encode, "doc_id long, shard int, ids binary").repartitionById(
        max(1, len(cuts)), F.col("shard")
    )
    dealt.sortWithinPartitions("shard", "doc_id", "ids").mapInPandas(build, SCHEMA).write.option(
        "compression", "zstd"
    ).parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def _matrix(row) -> WaveletMatrix:
    return WaveletMatrix(int(row.n_tokens), list(row.zeros), list(row.planes), list(row.ranks))


def document_digests(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    Starts are sums of sums: of lengths within a block, of blocks within a shard, of the shards (at most
    MAX_SHARDS rows, the only step in one task).
    """

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lengths = np.asarray(row.lengths, np.int64)
                ends = np.cumsum(lengths)
                data = _matrix(row).decoded().astype("<u4")
                yield pd.DataFrame({
                    "shard": row.shard, "block": row.block, "within": ends - lengths,
                    "doc_id": pd.array(list(row.doc_ids), dtype="Int64"), "n_tokens": lengths,
                    "ids_crc32": [zlib.crc32(data[e - n: e].tobytes()) for e, n in zip(ends, lengths, strict=True)],
                })

    found = shards.mapInPandas(
        decode, "shard int, block int, within long, doc_id long, n_tokens long, ids_crc32 long"
    )
    blocks = shards.select("shard", "block", "n_tokens")
    before = (Window.unboundedPreceding, -1)
    in_shard = blocks.withColumn(
        "_before", F.coalesce(F.sum("n_tokens").over(
            Window.partitionBy("shard").orderBy("block").rowsBetween(*before)), F.lit(0)),
    ).drop("n_tokens")
    of_shard = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select(
        "shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(*before)), F.lit(0)).alias("_first"),
    )
    starts = in_shard.join(of_shard, "shard").select("shard", "block", (F.col("_first") + F.col("_before")).alias("_at"))
    return found.join(starts, ["shard", "block"]).select(
        "doc_id", (F.col("_at") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences of each asked token, counted by rank on every block's planes."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                matrix = _matrix(row)
                yield pd.DataFrame({"token": tokens, "n": [matrix.rank(t, matrix.n) for t in tokens]})

    return shards.mapInPandas(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position): every place of a token within its document, found by select on every block."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                matrix, ends = _matrix(row), np.cumsum(np.asarray(row.lengths, np.int64))
                places = np.array([matrix.select(token, k) for k in range(matrix.rank(token, matrix.n))], np.int64)
                doc = np.searchsorted(ends, places, "right")
                yield pd.DataFrame({
                    "doc_id": pd.array([row.doc_ids[d] for d in doc], dtype="Int64"),
                    "position": places - np.concatenate([[0], ends])[doc],
                })

    return shards.mapInPandas(find, "doc_id long, position long")


def encoded_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write a documents table as shard files below the shared folder and report what the files hold."""
    spark, path = docs.sparkSession, folder(docs.sparkSession, "wavelet")
    write_shards(docs, path, tokenizer, end_id)
    return document_digests(read_shards(spark, path))
