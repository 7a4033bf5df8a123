"""Language identification with string kernels.

A text's features are the character n-grams (1 to 3) it has, hashed per length; the kernel of two texts is
the number of n-grams both have, over the root of the product of their own numbers. `LANDMARKS` training texts
span the Nyström approximation, in which one kernel ridge regression per language, that language against the
rest, is solved. Scoring is two matrix products per batch: presence rows times landmarks, kernel values
times coefficients.

Learning uses a bounded sample: `PER_LANGUAGE` texts of each language and `SAMPLE` in all, chosen by hash of the id among
all rows allowed to teach. Whole texts are used throughout, in windows, so memory does not grow with a text.

Rows: texts that are null or hold no letter are `und` with score 0, as are all where nothing could be learned.
Null languages don't teach; of ties the alphabetically first language wins; repeated rows count as often
as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dishlens.llm.common import id_mod, texts

#: Hash bits of the n-grams of each length.
SPACES = {1: 10, 2: 12, 3: 14}
WIDTH = sum(1 << b for b in SPACES.values())
PER_LANGUAGE, SAMPLE, LANDMARKS, RIDGE, SHARPNESS = 400, 4_000, 96, 1e-3, 5.0
_WINDOW, _ROWS = 1 << 20, 128


def presence(text: str, row: np.ndarray) -> None:
    """Set the places of all n-grams of the text in a row of zeros."""
    for start in range(0, max(1, len(text)), _WINDOW):
        part = text[start: start + _WINDOW + max(SPACES) - 1].lower()
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        gram, base = np.zeros(len(points), np.uint64), 0
        for n, bits in SPACES.items():
            if len(points) < n:
                break
            gram = gram[: len(points) - n + 1] * np.uint64(1_114_112) + points[n - 1:]
            row[base + ((gram * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)] = 1
            base += 1 << bits


@dataclass
class Model:
    """Packed landmark rows, coefficients (landmark x language) and the languages' names."""

    landmarks: np.ndarray
    weights: np.ndarray
    names: list[str]

    def __post_init__(self):
        self._dense = None

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        if self._dense is None:
            rows = np.unpackbits(self.landmarks, axis=1, count=WIDTH).astype(np.float32)
            self._dense = rows, np.sqrt(np.maximum(rows.sum(1), 1))
        return self._dense

    def __getstate__(self):
        return self.__dict__ | {"_dense": None}


def kernel(rows: np.ndarray, marks: np.ndarray, norms: np.ndarray) -> np.ndarray:
    own = np.sqrt(np.maximum(rows.sum(1), 1))
    return (rows @ marks.T) / own[:, None] / norms[None, :]


def fit(packed: np.ndarray, names: np.ndarray) -> Model | None:
    """One-versus-rest kernel ridge regression on landmarks, from packed presence rows and their languages."""
    known = sorted(set(names))
    if not known:
        return None
    take = []  # landmarks: the languages in turn
    by = [np.flatnonzero(names == k) for k in known]
    for k in range(max(map(len, by))):
        take += [b[k] for b in by if k < len(b)]
    marks = packed[take[:LANDMARKS]]
    model = Model(marks, np.zeros((len(marks), len(known)), np.float32), known)
    dense, norms = model.dense()
    blocks = [
        kernel(np.unpackbits(packed[k: k + 256], axis=1, count=WIDTH).astype(np.float32), dense, norms)
        for k in range(0, len(packed), 256)
    ]
    k_nm = np.concatenate(blocks).astype(float)
    k_mm = kernel(dense, dense, norms).astype(float)
    goal = np.where(names[:, None] == np.array(known)[None, :], 1.0, -1.0)
    # every language weighs the same, however often it occurs
    weight = (1 / np.array([len(b) for b in by]))[np.searchsorted(known, names)][:, None] * len(names) / len(known)
    left = k_nm.T @ (k_nm * weight) + RIDGE * len(names) * k_mm + 1e-6 * np.eye(len(marks))
    model.weights = np.linalg.solve(left, k_nm.T @ (goal * weight)).astype(np.float32)
    return model


def train(docs: DataFrame, teaches: Column) -> Model | None:
    """Fit on a sample of the rows for which `teaches` holds; presence bits, not texts, reach the driver."""
    pool = docs.filter(teaches & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")
    )
    mixed = F.xxhash64("doc_id")
    first = F.row_number().over(Window.partitionBy("lang").orderBy(mixed, "doc_id"))
    chosen = pool.withColumn("_n", first).filter(F.col("_n") <= PER_LANGUAGE).orderBy("_n", mixed, "lang").limit(SAMPLE)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bits = []
            for text in pdf["text"]:
                row = np.zeros(WIDTH, np.uint8)
                presence(text, row)
                bits.append(np.packbits(row).tobytes())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang": pdf["lang"], "bits": bits})

    # at most SAMPLE rows of two numbers, whatever the table's size
    sample = texts(docs).join(F.broadcast(chosen.select("doc_id", "lang").distinct()), "doc_id")
    found = sample.filter(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text").mapInPandas(
        pack, "doc_id long, lang string, bits binary"
    ).orderBy(F.xxhash64("doc_id"), "doc_id", "lang", "bits").limit(SAMPLE).toPandas()
    if found.empty:
        return None
    return fit(np.stack([np.frombuffer(b, np.uint8) for b in found["bits"]]), found["lang"].to_numpy(object).astype(str))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # LANDMARKS packed rows and coefficients: under 1 MB

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        dense = np.zeros((_ROWS, WIDTH), np.float32)
        for pdf in batches:
            text = pdf["text"].to_numpy(object)
            lang, share = np.full(len(text), "und", object), np.zeros(len(text))
            usable = [k for k, t in enumerate(text) if any(map(str.isalpha, t))] if model else []
            for start in range(0, len(usable), _ROWS):
                part = usable[start: start + _ROWS]
                dense[:] = 0
                for row, k in zip(dense, part, strict=False):
                    presence(text[k], row)
                values = kernel(dense[: len(part)], *model.dense()) @ model.weights
                odds = np.exp(SHARPNESS * (values - values.max(1, keepdims=True)))
                best = odds.argmax(1)
                lang[part] = np.array(model.names, object)[best]
                share[part] = odds.max(1) / odds.sum(1)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": lang, "score": share})

    return texts(docs).mapInPandas(score, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); rows whose crc32(doc_id) modulo `folds` is 0 never teach."""
    model = train(docs, id_mod(folds) != 0)
    return predict(docs, model).select(
        "doc_id", F.coalesce(id_mod(folds) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
