import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from dishlens.functions import keys, vectors
from dishlens.operators import fold, knn, merge as M, snapshots
from dishlens.operators.counters import counted
from dishlens.operators.dedup import top_per_key
from dishlens.operators.paging import limit_records, page_bounds


def test_uuid5_equals_the_standard(spark):
    names = ["", "a", "naïve — 東京", "x" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for space in (keys.NS_URL, keys.NS_OID, keys.NS_MENU_ITEM):
        got = [r[0] for r in df.select(keys.uuid5(space, "n")).collect()]
        assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]


BASE = [("a", 1, "old", None), ("b", 2, "old", "kept")]
BATCH = [("b", 20, "new", None), ("c", 30, "new", "x")]


def frames(spark):
    schema = "k string, n int, s string, t string"
    return spark.createDataFrame(BASE, schema), spark.createDataFrame(BATCH, schema)


def test_merge_rules(spark, rows):
    base, batch = frames(spark)
    merged = M.merge_upsert(base, batch, ["k"], rules={"t": M.NEW_OR_OLD, "n": lambda new, old: new + old},
                            on_insert={"s": F.lit("fresh")})
    assert rows(merged) == [("a", 1, "old", None), ("b", 22, "new", "kept"), ("c", 30, "fresh", "x")]


def test_merge_keeps_columns_the_batch_lacks(spark, rows):
    base, batch = frames(spark)
    merged = M.merge_upsert(base, batch.select("k", "n"), ["k"])
    assert rows(merged) == [("a", 1, "old", None), ("b", 20, "old", "kept"), ("c", 30, None, None)]


@pytest.mark.parametrize("apply", [
    lambda b, n: M.merge_upsert(b, n, ["k"], rules={"t": M.NEW_OR_OLD, "s": M.OLD}),
    lambda b, n: M.insert_absent(b, n, ["k"]),
    lambda b, n: M.delete_keys(b, n, ["k"]),
    lambda b, n: M.replace_children(b, n, n, "k"),
    lambda b, n: M.update_matched(b, n, ["k"], {"n": F.col("new.n")}),
])
def test_twice_equals_once(spark, rows, apply):
    base, batch = frames(spark)
    once = apply(base, batch)
    assert rows(apply(once, batch)) == rows(once)


def test_last_of_batch(spark, rows):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", None, "n")], "k string, o int, v string")
    assert rows(M.last_of_batch(df, ["k"], ["o"]), "k", "v") == [("a", "z"), ("b", "n")]


def test_group_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    plan = top_per_key(df, ["k"], [F.desc("id")], 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan


# ---------------------------------------------------------------- state fold

def replay(state, events):
    """Row-at-a-time rules, for comparison."""
    status, count, error, stamp = state
    for _, at, new, n, err in events:
        if status == "scraped" and new != "scraped":
            continue
        count = count + n if new == "scraped" and status in ("scraped", "scraping") else n
        stamp = at if new == "scraped" else stamp
        status, error = new, err or None
    return status, count, error, stamp


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay(spark, seed):
    rng = random.Random(seed)
    kinds = ["scraping", "scraped", "failed_scrape", "url_found"]
    base, events, expected = [], [], {}
    for key in map(str, range(40)):
        state = (rng.choice(kinds), rng.randrange(9), rng.choice([None, "e0"]), None)
        # One key holds most events.
        n = 400 if key == "0" else rng.randrange(6)
        weights = [3, 0.02 if key == "0" else 2, 3, 2]
        mine = [(s, f"t{s:04d}", rng.choices(kinds, weights)[0], rng.randrange(20), rng.choice(["", "err"]))
                for s in rng.sample(range(10_000), n)]
        base.append((key, *state))
        events += [(key, *e) for e in mine]
        expected[key] = replay(state, sorted(mine))
    events.append(("unknown", 1, "t", "scraped", 5, ""))
    b = spark.createDataFrame(base, "camis string, status string, item_count int, last_error string, scraped_at string")
    e = spark.createDataFrame(events, "camis string, seq long, ts string, status string, item_count int, last_error string")
    got = {r[0]: tuple(r)[1:] for r in fold.fold_scrape_results(b, e).collect()}
    assert got == expected


# ---------------------------------------------------------------- neighbours

@pytest.fixture
def vectors_and_queries(spark):
    rng = np.random.default_rng(5)
    table = rng.normal(size=(300, 8))
    table[100:200] = table[0]  # a third of the rows are copies
    table[7] = 0
    queries = rng.normal(size=(9, 8))
    queries[0] = table[0]
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(table)], "id long, v array<float>")
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)], "qid string, q array<float>")
    as32 = table.astype("float32").astype("float64")
    q32 = queries.astype("float32").astype("float64")
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, np.nan)
    scores = unit(q32) @ unit(as32).T
    expected = {}
    for i in range(len(queries)):
        order = sorted((j for j in range(300) if not np.isnan(scores[i, j])), key=lambda j: (-round(scores[i, j], 9), j))
        expected[f"q{i}"] = order[:5]
    return t, q, expected


@pytest.mark.parametrize("cells", [knn.MAX_QUERY_CELLS, 16])
def test_batch_search_is_exact(spark, monkeypatch, vectors_and_queries, cells):
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 4)
    monkeypatch.setattr(knn, "SHARD_ROWS", 90)
    t, q, expected = vectors_and_queries
    found = knn.nearest_batch(t.repartition(3), "v", "id", q, "q", "qid", 5, max_query_cells=cells).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.qid, []).append(r.id)
    assert got == expected


def test_copies_do_not_multiply_pairs(vectors_and_queries):
    scores = np.ones((2, 1000))
    at_query, at_row = knn._best(scores, 5)
    assert len(at_query) == 10 and set(at_row) == {0, 1, 2, 3, 4}


@pytest.mark.parametrize("cells", [knn.MAX_QUERY_CELLS, 16])
def test_nearest_match_both_ways(spark, vectors_and_queries, cells):
    t, q, _ = vectors_and_queries
    small = {r.id: r.qid for r in knn.nearest_match(t, "v", "id", q, "q", "qid").collect()}
    other = {r.id: r.qid for r in knn.nearest_match(t, "v", "id", q, "q", "qid", max_cells=cells).collect()}
    assert small == other and len(small) == 299


def test_both_scoring_engines_agree(spark):
    rng = np.random.default_rng(1)
    odd = [(None,), ([0.0] * 16,), ([1.0] * 15,), ([],)]
    df = spark.createDataFrame([(rng.normal(size=16).tolist(),) for _ in range(20)] + odd, "v array<float>")
    query = rng.normal(size=16).tolist()
    a, b = vectors.certainty("v", query, engine="jvm"), vectors.certainty("v", query, engine="arrow")
    for x, y in df.select(a, b).collect():
        assert (x is None and y is None) or x == pytest.approx(y, abs=1e-12)


def test_dimension_guard(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None)], "id int, v array<float>")
    good, bad = vectors.split_by_dimension(df, "v", 2)
    assert [r.id for r in good.collect()] == [1]
    assert [r.reason for r in bad.orderBy("id").collect()] == ["vector has dim 1, expected 2", "missing vector"]


# ---------------------------------------------------------------- pages, snapshots

def test_page_bounds():
    assert page_bounds("", "") == (0, 20) and page_bounds("3", "10") == (20, 10)
    assert page_bounds("0", "-5") == (0, 20) and page_bounds("x", "999") == (0, 100)
    assert page_bounds("2", "999", default=50, cap=200) == (200, 200)


def test_limit_records(spark):
    df = spark.range(10)
    order = [F.asc("id")]
    assert [r.id for r in limit_records(df, order, 3, 4).collect()] == [4, 5, 6]
    assert [r.id for r in limit_records(df, order, 0, 8).collect()] == [8, 9]
    assert limit_records(df, order, 0, 20).count() == 0 and limit_records(df, order).count() == 10


def test_newest_batch_of_a_key_counts(spark, tmp_path, rows):
    root, schema = f"file://{tmp_path}/t", "k string, v int"

    def current():
        return rows(snapshots.read_current(spark, root, schema, ["k"]))

    def frame(*data):
        return spark.createDataFrame(list(data), schema)

    assert current() == []
    snapshots.append_batch(frame(("a", 1), ("b", 1), ("b", 2)), root, 0)
    snapshots.append_batch(frame(("b", 3)), root, 1)
    snapshots.append_batch(frame(("a", 4), ("c", 5), ("c", 6)), root, 2)
    (tmp_path / "t" / "batch=3").mkdir()  # a job died here
    now = [("a", 4), ("b", 3), ("c", 5), ("c", 6)]
    assert current() == now
    snapshots.append_batch(frame(("a", 4), ("c", 5), ("c", 6)), root, 2)  # the same batch again
    assert current() == now
    snapshots.append_batch(frame(("a", 7)), root, 3)
    assert current() == [("a", 7), *now[1:]]


def test_counters_come_with_the_action(spark):
    rows, seen = counted(spark.range(10), "n", even=F.col("id") % 2 == 0, big=F.col("id") > 6)
    rows.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 10, "even": 5, "big": 3}


def test_merges_take_the_last_of_repeated_keys(spark, rows):
    base = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, n int, t string")
    batch = spark.createDataFrame([("a", 2, "old"), ("a", 3, "new"), ("c", 5, "p"), ("c", 5, "q")], "k string, n int, t string")
    want = [("a", 3, "new"), ("b", 1, "y"), ("c", 5, "q")]
    assert rows(M.merge_upsert(base, batch, ["k"], order=["n"])) == want
    moved = M.update_matched(base, batch, ["k"], {"t": F.col("new.t")}, order=["n"])
    assert rows(moved) == [("a", 1, "new"), ("b", 1, "y")]


def test_merges_move_change_times(spark, rows):
    base = spark.createDataFrame([("a", 1, "d1", "d1"), ("b", 1, "d1", "d1")], "k string, n int, created_at string, updated_at string")
    batch = spark.createDataFrame([("a", 2), ("c", 3)], "k string, n int")
    got = rows(M.merge_upsert(base, batch, ["k"], as_of=F.lit("d2")))
    assert got == [("a", 2, "d1", "d2"), ("b", 1, "d1", "d1"), ("c", 3, "d2", "d2")]
    got = rows(M.update_matched(base, batch, ["k"], {"n": F.col("new.n")}, as_of=F.lit("d2")))
    assert got == [("a", 2, "d1", "d2"), ("b", 1, "d1", "d1")]


def test_queries_of_several_widths_are_not_dropped(spark):
    t = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [1.0, 0.0, 0.0])], "qid string, q array<double>")
    with pytest.raises(ValueError):
        knn.nearest_batch(t, "v", "id", q, "q", "qid", 1)
    assert [tuple(r)[:2] for r in knn.nearest_batch(t, "v", "id", q, "q", "qid", 1, dim=2).collect()] == [("x", 1)]


def test_strict_outcomes_by_one_join_of_many_tasks(spark):
    """one join answers both, and adaptive execution doesn't glue its partitions into one task."""
    base = spark.range(0, 3000, 2).select(F.col("id").cast("string").alias("k"))
    batch = spark.range(1000, 4000).select(F.col("id").cast("string").alias("k"), F.lit("x").alias("v"))
    with_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        applied, rejected = M.strict_create(base, batch, ["k"])
        tasks = applied.rdd.getNumPartitions()
        judged = M.strict_outcomes(base, batch, ["k"])
        assert judged._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
        got = {(r.create, r.update): r["count"] for r in judged.groupBy("create", "update").count().collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_broadcast)
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert got == {("conflict", "applied"): rejected.count(), ("applied", "not found"): applied.count()} == {
        ("conflict", "applied"): 1000, ("applied", "not found"): 2000
    }
