"""Keyword search without reading texts: postings with block maxima.

`write_postings` makes a table of (term, block, most, ids, tfs, lengths): the documents of one block that hold the term, with
their counts and lengths, and the largest score the term gives any of them. Each file is sorted by term, so a query reads the
pages of its terms only. A search first adds up the maxima per block, a few bytes for each; the blocks of the largest bounds
give a first k-th best score, and only blocks whose bound reaches it are opened. The scores are those of
`functions.text.bm25`, the answer that of `search.keyword_rank`; texts are read for the answer alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dishlens import constants as K
from dishlens.functions.text import TOKEN, query_terms
from dishlens.operators.spread import spread_small

# Documents of a block, at most; blocks opened for the first k-th best score.
BLOCK_DOCUMENTS, FIRST_BLOCKS = 512, 8
# Up to this size texts are spread over the cores; above, tasks stay as small as those of the scan.
SPREAD_BYTES = 32 * 1024 * 1024
WORD = re.compile(TOKEN)


def _part(tf: Column | np.ndarray, length: Column | np.ndarray) -> Column | np.ndarray:
    """What one term adds to the score of a document, before its weight in the query."""
    damp = K.BM25_K1 * (1 - K.BM25_B) + K.BM25_K1 * K.BM25_B / K.BM25_AVG_LENGTH * length
    return tf * (K.BM25_K1 + 1) / (tf + damp)


def _block(ids: pa.Array, texts: list[str], number: int) -> pa.RecordBatch:
    """The rows of one block, by term; postings by id."""
    counts = [Counter(WORD.findall(text)) for text in texts]
    terms = pa.array([term for count in counts for term in count], pa.string()).dictionary_encode()
    codes = terms.indices.to_numpy()
    tf = np.fromiter((n for count in counts for n in count.values()), np.int32, len(codes))
    doc = np.repeat(np.arange(len(counts)), [len(count) for count in counts])
    length = np.array([count.total() for count in counts], np.int32)[doc]
    rank = pc.rank(ids, null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    order = np.lexsort((length, tf, rank[doc], codes))
    codes, tf, length, doc = codes[order], tf[order], length[order], doc[order]
    starts = np.flatnonzero(np.diff(codes, prepend=-1))
    ends = pa.array(np.append(starts, len(codes)), pa.int32())
    most = np.maximum.reduceat(_part(tf.astype(float), length.astype(float)), starts) if len(codes) else np.zeros(0)
    lists = [pa.ListArray.from_arrays(ends, values) for values in (ids.take(pa.array(doc)), pa.array(tf), pa.array(length))]
    columns = [terms.dictionary.take(pa.array(codes[starts])), pa.array(np.full(len(starts), number)), pa.array(most), *lists]
    return pa.RecordBatch.from_arrays(columns, ["term", "block", "most", "ids", "tfs", "lengths"])


def postings(docs: DataFrame, text: str, id_col: str, block_documents: int) -> DataFrame:
    """(term, block, most, ids, tfs, lengths): a block is a run of documents as they are read, so no posting is shuffled to its block."""
    kind = docs.schema[id_col].dataType.simpleString()
    # the same lower case as the scan's, whatever the locale of a worker
    rows = spread_small(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), SPREAD_BYTES).filter("text IS NOT NULL").select(
        "id", F.lower("text").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for start in range(0, batch.num_rows, block_documents):
                part = batch.slice(start, block_documents)
                yield _block(part.column(0), part.column(1).to_pylist(), number)
                number += 1

    return rows.mapInArrow(
        count, f"term string, block long, most double, ids array<{kind}>, tfs array<int>, lengths array<int>"
    )


def write_postings(docs: DataFrame, text: str, id_col: str, root: str, block_documents: int = BLOCK_DOCUMENTS) -> None:
    """Build the index below `root`: one pass over the texts, each task sorts and writes the blocks of what it read."""
    postings(docs, text, id_col, block_documents).sortWithinPartitions("term", "block").write.mode("overwrite").parquet(root)


def keyword_search(spark: SparkSession, root: str, query_text: str, id_col: str, limit: int) -> DataFrame:
    """(id, score) of the best texts, ties by id; texts without any term are never in it."""
    terms = query_terms(query_text)
    index = spark.read.parquet(root)
    kind = index.schema["ids"].dataType.elementType.simpleString()
    if not terms:
        return spark.createDataFrame([], f"{id_col} {kind}, score double")
    wanted = sorted(set(terms))
    held = index.filter(F.col("term").isin(wanted))
    weight = F.lit(0.0)
    for term in wanted:
        weight = F.when(F.col("term") == term, F.lit(float(terms.count(term)))).otherwise(weight)
    bounds = held.groupBy("block").agg(F.sum(weight * F.col("most")).alias("bound"))

    def scores(blocks: DataFrame) -> DataFrame:
        opened = held.join(blocks.select("block"), "block", "left_semi").select(
            "term", F.inline(F.arrays_zip(F.col("ids").alias("id"), F.col("tfs").alias("tf"), F.col("lengths").alias("length")))
        )
        part = _part(F.col("tf").cast("double"), F.col("length").cast("double"))
        # one sum per term, added in the terms' order, as the scan adds them: equal texts get equal numbers
        sums = opened.groupBy("id").agg(*[
            F.coalesce(F.sum(F.when(F.col("term") == t, part)), F.lit(0.0)).alias(f"_{n}") for n, t in enumerate(wanted)
        ])
        total = F.lit(0.0)
        for n, term in enumerate(wanted):
            total += F.lit(float(terms.count(term))) * F.col(f"_{n}")
        return sums.select("id", (F.lit(math.log(2)) * total / len(terms)).alias("score"), total.alias("_total"))

    order = [F.desc("score"), F.asc("id")]
    first = scores(bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)).orderBy(F.desc("_total")).limit(limit)
    reached = first.agg(F.when(F.count(F.lit(1)) == limit, F.min("_total")).otherwise(0.0).alias("least"))
    # bounds are added in another order than scores: give them a hair's breadth
    enough = bounds.filter(F.col("bound") * (1 + 1e-9) >= reached.scalar())
    return scores(enough).orderBy(*order).limit(limit).select(F.col("id").alias(id_col), "score")
