"""Training-corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dishlens.llm import decontaminate, packing, secrets, simhash, toxicity
from dishlens.llm.common import prepare, table, written
from dishlens.llm.queries import PACK_ID, SEQUENCE, TOKENIZER

#: No SQL can say a trained score, components or a tokenizer; tests/llm holds the rows against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like labelled toxic ones go."""
    return toxicity.without_toxic(docs, table(prepare(spark), sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked the one of smallest id stays."""
    prepare(spark)
    return simhash.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other values, go."""
    return decontaminate.without_benchmark(docs, table(prepare(spark), sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay."""
    prepare(spark)
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become token sequences of fixed length."""
    prepare(spark)
    return packing.pack_documents(docs, TOKENIZER, PACK_ID, SEQUENCE)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("secrets", secret_scan),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
