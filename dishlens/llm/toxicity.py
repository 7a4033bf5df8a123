"""Toxicity from the nearest labelled examples.

Terms are words and, of longer ones, their beginnings of five letters. A bounded sample of labelled documents are the examples;
their whole vocabulary makes the vectors. A term's weight is (1 + log tf) * idf, with document frequencies counted over all
documents, times a factor of 1 or more for terms that mark label 1 in the sample, near copies counted once. So every
text meets its nearest examples, whatever its words, and marking terms only draw texts that share them closer together.

The examples stand in blocks of `BLOCK` in an inverted index: postings of a term come block by block with the largest weight
of each block. The `DENSE` most frequent terms have a matrix instead of postings, multiplied with many texts at once. The
bound of a block is its largest product plus the text's other weights times the block's maxima; blocks are opened
in the order of their bounds, and those whose bound is below the k-th best cosine never are, so the nearest are exact.
The score is the vote of the nearest examples, each weighing 1 / (distance + NEAR)^2 with distance = 1 - cosine, drawn
towards the rate of label 1 among all examples by `PRIOR` votes. A copy of an example so outvotes its other neighbours.

Rows: null and empty texts, and texts without any word of the sample, get the rate of label 1; null labels don't teach, of
contradicting labels of one id the larger counts; equal cosines rank by id; equal texts have equal scores; without
labels all scores are 0; very long texts are read whole, as counts of the sample's terms; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dishlens.llm.common import id_mod, texts, written
from dishlens.llm.tokens import distinct_chunks, gathered, plain_chunks, text_runs

#: Bounds of the labelled sample, by label.
TOXIC, CLEAN = 500, 1_000
START, REMEMBERED = 5, 50_000
NEIGHBOURS, BLOCK, DENSE, TEXTS, PRIOR, NEAR, SUSPECT = 15, 64, 2048, 64, 0.5, 0.05, 0.7
#: A term marks label 1 if its root of twice the log-likelihood ratio is above SURE; each step above adds GAIN.
SURE, GAIN = 5.0, 3.0
_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str) -> list[str]:
    """Words of a text, and the beginnings of words longer than START (marked with a star)."""
    found = _WORD.findall(text.lower())
    return found + [word[:START] + "*" for word in found if len(word) > START]


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The whole numbers of all ranges start .. start + length, one after another."""
    ends = lengths.cumsum()
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Examples as vectors over the terms, their labels, and block maxima of each term's weights."""

    def __init__(self, terms: dict[str, int], weight: np.ndarray, vectors: list[tuple[np.ndarray, np.ndarray]], labels, ids):
        """`vectors` are (term numbers, weights) of length one; `weight` is idf times the factor, per term."""
        self.terms, self.weight = terms, weight
        labels, ids = np.asarray(labels, float), np.asarray(ids, np.int64)
        self.base_rate = float(labels.mean()) if len(labels) else 0.0
        often = np.bincount(np.concatenate([t for t, _ in vectors] or [np.zeros(0, int)]), minlength=len(weight))
        frequent = np.argsort(-often, kind="stable")[:DENSE]
        self.dense_of = np.full(len(weight), -1, np.int32)
        self.dense_of[frequent] = np.arange(len(frequent))
        # examples whose heaviest frequent term is the same, so mostly of one language, share blocks
        heaviest = [max(((w, -c) for c, w in zip(self.dense_of[t], v, strict=True) if c >= 0), default=(0, 0))[1] for t, v in vectors]
        order = np.lexsort((ids, np.array(heaviest, int))) if len(vectors) else np.zeros(0, int)
        self.labels, self.ids = labels[order], ids[order]
        self.n_blocks = -(-len(order) // BLOCK)
        self.dense = np.zeros((self.n_blocks * BLOCK, len(frequent)), np.float32)
        self.query = np.zeros(len(weight))  # of the text at hand
        # the examples as they are, for the cosines of those found
        self.held = np.cumsum([0] + [len(vectors[e][0]) for e in order])
        self.held_term = np.concatenate([vectors[e][0] for e in order] or [np.zeros(0, int)]).astype(np.int32)
        self.held_value = np.concatenate([vectors[e][1] for e in order] or [np.zeros(0)]).astype(np.float32)
        term, row, value = [], [], []
        for at, example in enumerate(order):
            t, v = vectors[example]
            column = self.dense_of[t]
            self.dense[at, column[column >= 0]] = v[column >= 0]
            term.append(t[column < 0])
            value.append(v[column < 0])
            row.append(np.full((column < 0).sum(), at))
        term, row, value = (np.concatenate(x) if x else np.zeros(0, int) for x in (term, row, value))
        by = np.lexsort((row, term))
        term, row, self.value = term[by], row[by], value[by].astype(np.float32)
        self.place = (row % BLOCK).astype(np.int32)
        starts = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(row // BLOCK) != 0))) if len(term) else np.zeros(0, int)
        self.start, self.length = starts, np.diff(np.append(starts, len(term)))
        self.block = (row[starts] // BLOCK).astype(np.int32)
        self.most = np.maximum.reduceat(self.value, starts) if len(starts) else np.zeros(0, np.float32)
        self.first = np.searchsorted(term[starts], np.arange(len(weight) + 1))

    def nearest(self, texts: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each text (terms, weights) the k examples of largest cosine above 0, exactly: (example numbers, cosines),
        and how many blocks were opened."""
        queries = np.zeros((len(texts), self.dense.shape[1]), np.float32)
        for query, (terms, weights) in zip(queries, texts, strict=True):
            column = self.dense_of[terms]
            query[column[column >= 0]] = weights[column >= 0]
        for products, (terms, weights) in zip(queries @ self.dense.T, texts, strict=True):
            products = products.reshape(self.n_blocks, BLOCK)
            rare = self.dense_of[terms] < 0
            first = self.first[terms[rare]]
            many = self.first[terms[rare] + 1] - first
            runs, weight = spans(first, many), np.repeat(weights[rare], many)
            bound = products.max(1, initial=0) + np.bincount(self.block[runs], weight * self.most[runs], self.n_blocks)
            order = np.argsort(-bound, kind="stable")
            opened, least, seen = 0, 5e-7, []
            for step in (4, self.n_blocks):  # what the first blocks leave in question is opened at once
                chosen = order[opened: opened + step]
                chosen = chosen[bound[chosen] >= least - 1e-5]
                if not len(chosen):
                    break
                cosines = products[chosen] + self._rest(chosen, runs, weight)
                block, place = np.nonzero(cosines >= max(least - 1e-5, 2e-7))
                seen.append((chosen[block] * BLOCK + place, cosines[block, place]))
                opened += len(chosen)
                so_far = np.concatenate([c for _, c in seen])
                if k < len(so_far):
                    least = max(least, float(np.partition(so_far, -k)[-k]))
            found = np.concatenate([e[c >= least - 1e-5] for e, c in seen] or [np.zeros(0, int)])
            found = found[found < len(self.ids)]
            exact = self._cosines(found, terms, weights)
            best = sorted((-c, int(self.ids[n]), int(n)) for c, n in zip(exact.tolist(), found.tolist(), strict=True) if c > 0)[:k]
            yield np.array([b[2] for b in best], np.int64), np.array([-b[0] for b in best]), opened

    def _rest(self, blocks: np.ndarray, runs: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What the postings add to the products of all examples of some blocks: block x place."""
        at = np.full(self.n_blocks, -1)
        at[blocks] = np.arange(len(blocks))
        here = at[self.block[runs]]
        runs, weight, here = runs[here >= 0], weight[here >= 0], here[here >= 0]
        length = self.length[runs]
        posting = spans(self.start[runs], length)
        cells = np.repeat(here * BLOCK, length) + self.place[posting]
        sums = np.bincount(cells, np.repeat(weight, length) * self.value[posting], len(blocks) * BLOCK)
        return sums.reshape(len(blocks), BLOCK)

    def _cosines(self, examples: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines in full precision, the same for equal texts whatever they were multiplied with."""
        self.query[terms] = weights
        first, length = self.held[examples], self.held[examples + 1] - self.held[examples]
        at = spans(first, length)
        parts = self.query[self.held_term[at]] * self.held_value[at]
        self.query[terms] = 0
        sums = np.zeros(len(examples))
        full = length > 0
        if full.any():
            sums[full] = np.add.reduceat(parts, (length.cumsum() - length)[full])
        return np.round(sums, 6)

    def scores(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, list[int]]]:
        """Votes of the nearest examples and the ids of the three nearest."""
        for at, cosine, _ in self.nearest(texts, NEIGHBOURS):
            votes = 1 / (np.maximum(1 - cosine, 0) + NEAR) ** 2
            total = float(votes @ self.labels[at]) + PRIOR * self.base_rate
            yield total / (float(votes.sum()) + PRIOR), [int(i) for i in self.ids[at[:3]]]


def vector(hits: list[int], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights (1 + log tf) * weight of length one."""
    terms, counts = np.unique(np.array(hits, np.int64), return_counts=True)
    weights = (1 + np.log(counts)) * weight[terms]
    return terms, weights / max(float(np.sqrt((weights**2).sum())), 1e-12)


def lookup(terms: dict[str, int]) -> Callable[[str], list[int]]:
    """Function from a text to the numbers of the sample's terms in it, repeats included."""
    starts = {t[:-1]: n for t, n in terms.items() if t[-1] == "*"}

    def hits(text: str) -> list[int]:
        found = _WORD.findall(text.lower())
        out = [n for n in map(terms.get, found) if n is not None]
        return out + [n for n in map(starts.get, [w[:START] for w in found if len(w) > START]) if n is not None]

    return hits


class TermCounts:
    """What `lookup` finds, counted for many texts at once: Arrow parts them, and equal chunks are looked up once a run."""

    def __init__(self, terms: dict[str, int]):
        self.other, self.n = lookup(terms), max(len(terms), 1)
        self.tables = []
        for names in (terms, {t[:-1]: k for t, k in terms.items() if t[-1] == "*"}):
            self.tables.append((pa.array(list(names), "large_string"), np.array([*names.values(), -1], np.int64)))

    def _numbers(self, names: pa.Array, table: tuple[pa.Array, np.ndarray]) -> np.ndarray:
        at = pc.index_in(names, value_set=table[0]).fill_null(-1).to_numpy(zero_copy_only=False)
        return table[1][at]

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each run of texts: term numbers, ascending in each text, their counts, and where each text starts and the last one ends."""
        for run in text_runs(texts.cast("large_string")):
            chunks, chunk, offsets = distinct_chunks(run)
            letters, _, other = plain_chunks(chunks)
            starts = pc.if_else(pc.greater(pc.utf8_length(letters), START), pc.utf8_slice_codeunits(letters, 0, START), None)
            both = np.stack([self._numbers(x, table) for x, table in zip((letters, starts), self.tables, strict=True)], 1)
            extra = [self.other(chunks[int(k)].as_py()) for k in other]
            size = np.append((both >= 0).sum(1), np.array([len(x) for x in extra], np.int64))
            values = np.concatenate([both[both >= 0], *[np.array(x, np.int64) for x in extra]])
            number = np.arange(len(chunks))
            number[other] = len(chunks) + np.arange(len(other))
            place = number[chunk]
            ends = np.append(0, size[place].cumsum())[offsets]
            found = np.repeat(np.arange(len(run)), np.diff(ends)) * self.n + gathered(values, size, place)
            found, counts = np.unique(found, return_counts=True)
            yield found % self.n, counts, np.searchsorted(found, np.arange(len(run) + 1) * self.n)

    def vectors(self, texts: pa.Array, weight: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for terms, counts, bounds in self.runs(texts):
            weights = (1 + np.log(counts)) * weight[terms]
            for a, b in zip(bounds, bounds[1:]):
                yield terms[a:b], weights[a:b] / max(float(np.sqrt((weights[a:b] ** 2).sum())), 1e-12)


# ---- learning ------------------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, teaches: Column) -> DataFrame:
    """(doc_id, label, text): up to TOXIC and CLEAN documents that may teach, chosen by hash of the id."""
    given = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("doc_id")
    ).agg(F.max("toxic").cast("int").alias("label")).filter(teaches)
    mixed = (F.xxhash64(F.col("doc_id"), F.lit("sample")), F.col("doc_id"))
    chosen = [given.filter(F.col("label") == y).orderBy(*mixed).limit(n) for y, n in ((1, TOXIC), (0, CLEAN))]
    return written(texts(docs).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id"), "labelled")


def distinct_examples(sample: DataFrame) -> pd.DataFrame:
    """(doc_id, label) without near copies: documents that share the smallest of their shingle hashes are one.

    Hashes of five words under three seeds; the sample's bound holds for what reaches the driver.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["text"]:
                words = text.split()
                shingles = [" ".join(words[k: k + 5]) for k in range(max(1, len(words) - 4))]
                rows.append([min(xxhash.xxh64_intdigest(s, seed) >> 1 for s in shingles) for seed in (1, 2, 3)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "label": pdf["label"], "sketch": rows})

    found = sample.mapInPandas(sketch, "doc_id long, label int, sketch array<long>").toPandas().sort_values("doc_id")
    seen: list[set[int]] = [set(), set(), set()]
    keep = []
    for values in found["sketch"]:
        new = not any(v in s for v, s in zip(values, seen, strict=True))
        for v, s in zip(values, seen, strict=True):
            s.add(v)
        keep.append(new)
    return found[np.array(keep, bool)][["doc_id", "label"]].drop_duplicates("doc_id")


def vocabulary(sample: DataFrame, kept: pd.DataFrame) -> pd.DataFrame:
    """(term, n0, n1): every term of the sample, and how many of the kept documents of each label hold it."""
    labels = dict(zip(kept["doc_id"], kept["label"], strict=True))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [Counter(), Counter(), Counter()]
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                found[labels.get(doc_id, 2)].update(set(terms_of(text)))
            rows = {t: (found[0][t], found[1][t]) for t in found[0] | found[1] | found[2]}
            yield pd.DataFrame([(t, *n) for t, n in rows.items()], columns=["term", "n0", "n1"])

    counts = sample.select("doc_id", "text").mapInPandas(count, "term string, n0 long, n1 long").groupBy("term")
    return counts.agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas().sort_values("term")


def marking(n0: np.ndarray, n1: np.ndarray, clean: int, toxic: int) -> np.ndarray:
    """Factor of each term: above 1 for terms more frequent with label 1 than chance explains, most for the purest."""
    if not clean or not toxic:
        return np.ones(len(n0))
    share = toxic / (clean + toxic)
    rate = np.clip(n1 / np.maximum(n0 + n1, 1), 1e-9, 1)
    gain = n1 * np.log(rate / share) + n0 * np.log(np.clip(1 - rate, 1e-9, 1) / (1 - share))
    purity = np.clip((rate - share) / (1 - share), 0, 1)
    return 1 + GAIN * np.maximum(np.sqrt(2 * np.maximum(gain, 0)) - SURE, 0) * purity


def document_frequencies(docs: DataFrame, terms: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sums, n = TermCounts(sent.value), np.zeros(len(sent.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for held, _, _ in found.runs(batch.column("text")):
                sums += np.bincount(held, minlength=len(sums))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], "int32"), pa.array([n, *sums[at]], "int64")], ["term", "n"])

    rows = texts(docs).select("text").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in rows.collect()}  # one row for each term
    return np.array([found.get(t, 0) for t in range(len(terms))], float), int(found.get(-1, 0))


def learn(docs: DataFrame, labels: DataFrame, teaches: Column) -> Index | None:
    sample = labelled_sample(docs, labels, teaches)
    kept = distinct_examples(sample)
    if kept.empty:
        return None
    found = vocabulary(sample, kept)
    terms = {t: k for k, t in enumerate(found["term"])}
    size = Counter(kept["label"])
    factor = marking(found["n0"].to_numpy(float), found["n1"].to_numpy(float), size[0], size[1])
    frequency, n = document_frequencies(docs, terms)
    weight = (np.log((1 + n) / (1 + frequency)) + 1) * factor
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = lookup(sent.value)
        for pdf in batches:
            yield pdf[["doc_id", "label"]].assign(hits=[found(t) for t in pdf["text"]])

    rows = sample.mapInPandas(hits, "doc_id long, label int, hits array<int>").toPandas()
    rows = rows.drop_duplicates("doc_id").sort_values("doc_id")
    return Index(terms, weight, [vector(h, weight) for h in rows["hits"]], rows["label"], rows["doc_id"])


# ---- scoring -------------------------------------------------------------------------------------


def scorer(index: Index | None):
    """Function from texts to their (score, evidence). Equal texts are scored once, as long as REMEMBERED others fit."""
    if index is None:
        return lambda texts: [(0.0, [])] * len(texts)
    counts = TermCounts(index.terms)
    known: dict[bytes, tuple[float, list[int]]] = {}

    def score(texts: list[str]) -> list[tuple[float, list[int]]]:
        digests = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = {d: t for d, t in zip(digests, texts, strict=True) if d not in known}
        names, vectors = iter(new), counts.vectors(pa.array(list(new.values()), "large_string"), index.weight)
        while part := list(islice(vectors, TEXTS)):
            known.update(zip(islice(names, len(part)), index.scores(part), strict=True))
        return [known[d] for d in digests]

    return score


def score_documents(docs: DataFrame, index: Index | None) -> DataFrame:
    """(doc_id, score, evidence): evidence are the ids of the nearest examples."""
    sent = docs.sparkSession.sparkContext.broadcast(index)  # bounded by the sample

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer(sent.value)
        for pdf in batches:
            found = score(pdf["text"].to_list())
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"], "score": [s for s, _ in found], "evidence": [e for _, e in found],
            })

    return texts(docs).mapInPandas(run, "doc_id long, score double, evidence array<long>")


def teaching(folds: int = 3) -> Column:
    return id_mod(folds) != 1


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence)."""
    index = learn(docs, labels, teaching(folds))
    return score_documents(docs, index).select(
        "doc_id", F.coalesce(id_mod(folds) == 1, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= SUSPECT, 1).otherwise(0).alias("predicted"), "evidence",
    )


def without_toxic(docs: DataFrame, labels: DataFrame, folds: int = 3) -> DataFrame:
    """The documents whose score is below SUSPECT, with all their columns; one pass, no join."""
    index = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, teaching(folds)))

    @F.pandas_udf("double")
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = scorer(index.value)
        for text in batches:
            yield pd.Series([s for s, _ in score(text.fillna("").to_list())], text.index, "float64")

    return docs.filter(rate("text") < SUSPECT)
