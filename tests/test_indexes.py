"""Stored indexes against plain scans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishlens.functions.vectors import certainty
from dishlens.operators import bucketed, buckets, codes, knn, trigrams
from dishlens.operators.merge import merge_upsert
from dishlens.plans import keywords, search as S

VECTORS = "id long, v array<float>"


@pytest.fixture(scope="module")
def vectors(spark):
    """Blobs with 700 copies of one vector, and rows without direction."""
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 32))
    rows = [(k, (middles[k % 12] + rng.normal(size=32) * 0.5).tolist()) for k in range(1500)]
    rows += [(k, [1.0] * 32) for k in range(2000, 2700)]
    rows += [(5000, None), (5001, [0.0] * 32), (5002, [1.0] * 31), (5003, [float("nan")] * 32), (5004, [])]
    return spark.createDataFrame(rows, VECTORS).repartition(4).cache()


def test_codes_find_the_exact_rows(spark, vectors, tmp_path):
    root = f"file://{tmp_path}/codes"
    codes.store(vectors, "v", "id", 32, root, 4)
    for seed in range(4):
        query = np.random.default_rng(seed).normal(size=32).tolist() if seed else [1.0] * 32
        near, read = codes.nearest_stored(spark, root, vectors.schema, "v", query, 10, "id")
        got = [(r.id, round(r.certainty, 9)) for r in near.orderBy(F.desc("certainty"), "id").collect()]
        plain = vectors.filter(F.size("v") == 32).withColumn("certainty", certainty("v", query)).filter("NOT isnan(certainty)")
        assert got == [(r.id, round(r.certainty, 9)) for r in plain.orderBy(F.desc("certainty"), "id").limit(10).collect()]
        assert read.rows == 2200 and 10 <= read.candidates < 800
        if seed:
            assert read.code_bytes + read.vector_bytes < read.plain_bytes
    assert codes.nearest_stored(spark, root, vectors.schema, "v", [0.0] * 32, 10, "id")[0].collect() == []


def test_codes_beyond_the_named_candidates(spark, vectors, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/codes"
    codes.store(vectors, "v", "id", 32, root, 2)
    monkeypatch.setattr(codes, "MAX_NAMED", 20)
    near, _ = codes.nearest_stored(spark, root, vectors.schema, "v", [1.0] * 32, 5, "id")
    assert sorted(r.id for r in near.collect()) == [2000, 2001, 2002, 2003, 2004]


def test_error_bounds_hold(spark, vectors):
    query = np.random.default_rng(9).normal(size=32)
    coded = vectors.select("v", codes.coded("v", 32).alias("c")).filter("c IS NOT NULL").collect()
    assert len(coded) == 2200
    unit = query / np.sqrt(query @ query)
    for r in coded[::7]:
        v = np.array(r.v)
        guess = np.frombuffer(r.c.code, np.int8) @ unit * r.c.scale
        assert abs(v @ unit / np.sqrt(v @ v) - guess) <= r.c.error < 0.05


def test_buckets_reach_the_recall(spark, vectors):
    asked = vectors.filter((F.col("id") % 20 == 0) & (F.size("v") == 32)).select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    found = buckets.nearest_batch_buckets(vectors, "v", "id", asked, "q", "q_id", 10, 32).cache()
    clean = vectors.filter("id < 5000")
    exact = knn.nearest_batch(clean, "v", "id", asked.filter("q_id < 5000"), "q", "q_id", 10, dim=32)
    assert buckets.recall(found, exact, "q_id", "id").first().recall >= 0.9
    copies = found.filter("q_id = 2000").orderBy("rank").collect()
    assert [r.id for r in copies] == list(range(2000, 2010))  # copies are handed out in order
    assert found.groupBy("q_id").count().agg(F.max("count")).first()[0] == 10
    assert buckets.nearest_batch_buckets(vectors.limit(0), "v", "id", asked, "q", "q_id", 10, 32).collect() == []


def test_one_hot_vector_makes_no_pairs_of_its_copies(spark, vectors):
    asked = vectors.filter("id BETWEEN 2000 AND 2699").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    found = buckets.nearest_batch_buckets(vectors, "v", "id", asked, "q", "q_id", 3, 32)
    assert found.count() == 2100


WORDS = "the of and rice soup leek entre cafe x1".split()


def texts(n):
    draw = random.Random(1)
    return [(k, " ".join(draw.choices(WORDS, k=draw.randrange(1, 60))).title()) for k in range(n)]


def test_keyword_index_equals_the_scan(spark, tmp_path):
    rows = texts(900) + [(1000, None), (1001, ""), (1002, "Rice-rice, RICE!"), (1003, "Reis \u00e9t\u00e9 rice"), (1004, "Rice-rice, RICE!")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(3)
    root = f"file://{tmp_path}/p"
    keywords.write_postings(docs, "text", "id", root, block_documents=40)
    for asked, n in (("rice", 20), ("leek soup leek", 7), ("the of and entre cafe", 50), ("none", 5), ("", 5), ("rice none", 2000)):
        got = keywords.keyword_search(spark, root, asked, "id", n).orderBy(F.desc("score"), "id").collect()
        want = S.keyword_rank(docs, "text", asked, "id", n).orderBy(F.desc("score"), "id").collect()
        assert [(r.id, round(r.score, 12)) for r in got] == [(r.id, round(r.score, 12)) for r in want]


def test_keyword_blocks_are_runs_of_the_scan(spark, tmp_path):
    """no shuffle brings postings to their blocks, which hold no more documents than asked for; ids may be text, repeat or lack."""
    rows = [(None if k % 50 == 0 else f"d{k // 2}", text) for k, text in texts(600)] + [("e", "\u0130 rice"), ("f", None)]
    docs = spark.createDataFrame(rows, "id string, text string").repartition(3)
    root = f"file://{tmp_path}/p"
    keywords.write_postings(docs, "text", "id", root, block_documents=7)
    index = spark.read.parquet(root)
    assert index.select(F.max(F.size("ids"))).first()[0] <= 7
    assert index.groupBy("term", "block").count().filter("count > 1").isEmpty()
    got = index.select("term", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p")).select("term", "p.*")
    words = docs.select("id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    parts = words.withColumn("n", F.monotonically_increasing_id()).select("id", "n", F.size("w").alias("length"), F.explode("w").alias("term"))
    want = parts.groupBy("term", "id", "n", "length").agg(F.count(F.lit(1)).alias("tf"))
    flat = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    assert flat(got, "term", F.col("ids").alias("id"), F.col("tfs").cast("long").alias("tf"), F.col("lengths").alias("length")) == flat(
        want, "term", "id", "tf", "length"
    )
    assert "Exchange hashpartitioning" not in keywords.postings(docs, "text", "id", 7)._jdf.queryExecution().executedPlan().toString()


def test_keyword_index_opens_few_blocks_and_no_texts(spark, tmp_path):
    rows = [(k, "rice " * (1 + (k % 97 == 0) * 30) + "soup " * 20) for k in range(2000)]
    root = f"file://{tmp_path}/p"
    keywords.write_postings(spark.createDataFrame(rows, "id long, text string"), "text", "id", root, block_documents=20)
    near = keywords.keyword_search(spark, root, "rice", "id", 5)
    assert len(near.collect()) == 5
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "text" not in plan.replace("context", "")


def test_patterns_by_trigrams(spark, tmp_path):
    names = ["Green Soup", "green_soup", "50% off Greens", "gr", "", None, "A\\B c", "GREEN", "x" * 500 + "end", "\u00c9t\u00e9 vert"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    root = f"file://{tmp_path}/t"
    trigrams.write_trigrams(df, "name", "id", root)
    for pattern in ("%green%", "green", "%g__en%oup", "%\\%%", "%50\\% o%", "%\\_sou%", "%", "", "%xxxx%end", "%t\u00e9 v%", "gr", "%aaa%"):
        got = trigrams.matching(spark, df, "name", "id", root, pattern)
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in df.filter(F.col("name").ilike(pattern)).collect()), pattern
    assert trigrams.literal_runs("%gr_en\\%x%") == ["gr", "en%x"]


def test_bucketed_merge_never_shuffles_the_base(spark, rows):
    base = spark.range(4000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 7).alias("v"))
    batch = spark.createDataFrame([(str(k), 100 + k) for k in range(3990, 4010)], "k string, v long")
    upsert = lambda old, new: merge_upsert(old, new, ["k"])
    name = bucketed.write_bucketed(base, "test_bucketed_merge", ["k"], 8)
    assert bucketed.bucket_count(spark, name) == 8
    plan = bucketed.merged_rows(spark, name, batch, ["k"], upsert, 8)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.split("\n") if "Scan parquet" in line)
    before = plan.split("\n")[: plan.split("\n").index(scan)]
    # the base's branch is the first of the join: no exchange between them
    assert "Bucketed: true" in scan and not any("Exchange" in line for line in before[next(i for i, x in enumerate(before) if "Join" in x):])
    assert plan.count("Exchange hashpartitioning") == 1
    want = rows(merge_upsert(base, batch, ["k"]))
    for _ in range(3):
        name = bucketed.merge_bucketed(spark, name, batch, ["k"], upsert)
        assert rows(spark.table(name)) == want
    for end in "01":
        spark.sql(f"DROP TABLE IF EXISTS test_bucketed_merge_{end}")


def test_bucket_bits_are_fitted_and_short_answers_filled(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(size=32).tolist()) for k in range(12_000)]  # no blobs: fine buckets lose most neighbours
    df = spark.createDataFrame(rows, VECTORS).repartition(4).cache()
    asked = df.filter("id % 400 = 0").select(F.col("id").alias("q_id"), F.col("v").alias("q"))
    exact = knn.nearest_batch(df, "v", "id", asked, "q", "q_id", 10, dim=32)
    fitted = buckets.nearest_batch_buckets(df, "v", "id", asked, "q", "q_id", 10, 32)
    assert buckets.recall(fitted, exact, "q_id", "id").first().recall >= 0.9
    fine = buckets.nearest_batch_buckets(df, "v", "id", asked, "q", "q_id", 10, 32, tables=1, bits=30)
    assert {r["count"] for r in fine.groupBy("q_id").count().collect()} == {10} and fine.count() == 300


def test_bucket_pairs_never_become_rows(spark):
    """pairs of a shared bucket carried their vectors through shuffles; now the best k of a task are all that leaves it."""
    df = spark.range(400).select("id", F.transform(F.sequence(F.lit(1), F.lit(32)), lambda n: F.sin(n * F.col("id")).cast("float")).alias("_v"))
    asked = df.filter("id < 100").select(F.col("id").alias("q_id"), F.col("_v").alias("_q"))
    plan = buckets._from_buckets(df, "id", asked, "q_id", 10, 32, 24, 4, 3, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1 and "WindowGroupLimit" in plan


@pytest.mark.parametrize("dense", [0.0, 1.0])
def test_bucket_scores_equal_all_pairs_of_shared_buckets(monkeypatch, dense):
    monkeypatch.setattr(buckets, "DENSE", dense)
    monkeypatch.setattr(buckets, "PAIRS", 900)  # several blocks of queries
    monkeypatch.setattr(buckets, "GATHERED_CELLS", 160)
    rng = np.random.default_rng(4)
    rows = knn._unit(np.concatenate([rng.normal(size=(290, 8)), np.ones((10, 8)), np.full((1, 8), np.nan)]))
    queries = knn._unit(np.concatenate([rng.normal(size=(40, 8)), np.ones((1, 8))]))
    planes = buckets._planes(8, 3, 4, 7)
    sides = lambda m: ((m @ planes).reshape(len(m), 3, 4) > 0)
    apart = (sides(queries)[:, None] != sides(rows)[None]).sum(3)
    nearest = np.abs((queries @ planes).reshape(-1, 3, 4)).argsort(2)[:, :, :2]
    for at in np.ndindex(apart.shape):  # one bit apart, at one of the two planes a query lies closest to
        if apart[at] == 1:
            bit = np.flatnonzero(sides(queries)[at[0], at[2]] != sides(rows)[at[1], at[2]])[0]
            apart[at] = 0 if bit in nearest[at[0], at[2]] else 1
    scores = np.where((apart == 0).any(2), queries @ rows.T, -np.inf)
    scores = np.where(np.isnan(scores), -np.inf, scores)
    got = {q: [] for q in range(41)}
    for at_query, at_row, found in buckets._search(8, 3, 4, 2, 7)(queries)(rows, 5):
        for q, r, score in zip(at_query, at_row, found, strict=True):
            assert abs(score - scores[q, r]) < 1e-12
            got[q].append(r)
    for q in range(41):
        want = [r for r in np.lexsort((np.arange(301), -scores[q].round(12)))[:5] if np.isfinite(scores[q, r])]
        assert sorted(got[q]) == sorted(want)


def test_a_task_keeps_the_best_of_its_batches():
    rng = np.random.default_rng(6)
    kept, left = np.full((7, 3), -np.inf), []
    for batch in range(20):
        scores = rng.integers(0, 50, (7, 4)).astype("float64")
        at_query, at_row = knn._best(scores, 3)
        found = scores[at_query, at_row]
        good = knn._not_beaten(kept, at_query, found)
        left += [(q, batch, r, s) for q, r, s, g in zip(at_query, at_row, found, good, strict=True) if g]
        assert all(s < kept[q, 0] for q, s, g in zip(at_query, found, good, strict=True) if not g)
    for q in range(7):
        assert sorted(s for p, _, _, s in left if p == q)[-3:] == list(kept[q])
    assert len(left) < 20 * 7 * 3 / 2
