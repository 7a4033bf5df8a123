"""The operators over the given tables, with production parameters, as registered queries."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dishlens.llm import (
    centroids,
    decontaminate,
    language,
    licenses,
    merkle,
    packing,
    quality,
    secrets,
    shard_tree,
    simhash,
    toxicity,
    wavelet,
    whitening,
)
from dishlens.llm.common import prepare, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID, PACK_ID, SEQUENCE = 2, 1, 4096

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: What SQL can say; tests/llm has brute force for the others (checksums, trained models, tokenizers, components).
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_tree.shard_documents(table(spark, sf_dir, "documents"), shard_tree.balanced(16), 16)


@query
def op2_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_fingerprints(table(spark, sf_dir, "documents"))


@query
def op3_language_kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.encoded_digests(table(spark, sf_dir, "documents"), TOKENIZER, END_ID)


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER, PACK_ID, SEQUENCE)


@query
def op6_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_license_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files lie in directories by source and by thousands of ids."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text",
        F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string")).alias("path"),
    )
    return licenses.scan_licenses(docs)


@query
def op9_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op11_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts alone, which SQL can say."""
    return quality.counted(table(spark, sf_dir, "documents")).drop("words")


ORACLES["quality_rules"] = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM t)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1),
covered AS (
  SELECT r, sum(least(5, coalesce(after - i, 5))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM repeated) GROUP BY r),
lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(lines.n, 0) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM t LEFT JOIN covered USING (r) LEFT JOIN lines USING (r))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts
"""


@query
def op12_centroid_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clustered(table(spark, sf_dir, "embeddings"))


ORACLES["op12_centroid_drift"] = centroids.sql()


@query
def op13_shifted_cholesky(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query
def fingerprint_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op2: lengths and digests of the edited texts."""
    return merkle.document_fingerprints(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


ORACLES["fingerprint_texts"] = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next FROM t)
SELECT doc_id, length(text) AS n_chars,
  sha256(left(text, length(text) - length(text) // 4) || left(next, length(text) // 4)) AS edited_sha256
FROM n
"""


@query
def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op9: how many base matches of each kind."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


ORACLES["secret_counts"] = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(text, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12)) AS n_assign,
  len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access,
  len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
"""


@query
def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of op1: sizes, and that the slots of each shard are gapless from 0."""
    rows = shard_tree.shard_documents(table(spark, sf_dir, "documents"), shard_tree.balanced(16), 16)
    slots = rows.groupBy("shard").agg((F.count_distinct("slot") == F.max("slot") + 1).alias("gapless"), F.min("slot").alias("low"))
    return rows.join(slots, "shard").select("doc_id", "size", "gapless", "low")


ORACLES["shard_sizes"] = """
SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, true AS gapless, CAST(0 AS BIGINT) AS low
FROM documents
"""
