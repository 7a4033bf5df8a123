import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dishlens import schemas
from dishlens.operators import fold, joins
from dishlens.operators.snapshots import read_current
from dishlens.plans import indexing as I, menus as M, restaurants as R
from dishlens.streaming import counts as C, jobs as J, state as S

EVENT = "camis string, seq long, ts timestamp, status string, item_count int, last_error string"
BASE = "camis string, status string, item_count int, last_error string, scraped_at timestamp"


def events(spark, rows):
    df = spark.createDataFrame(rows, "camis string, seq long, status string, item_count int, last_error string")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq"))).select("camis", "seq", "ts", "status", "item_count", "last_error")


def folded(spark, base, source, out, log):
    """Work off what is new, then the base with all states so far, and the rows put aside."""
    changed = S.scrape_states(J.file_stream(spark, source, EVENT), base)
    J.run_available(changed, J.batch_folder_sink(out), log, "update").awaitTermination()
    rows = spark.read.parquet(out)
    aside = {(r.camis, r.kind, r.n) for r in rows.filter("kind <> 'state'").collect()}
    return S.with_states(base, rows), aside


def test_fold_over_several_batches_equals_one_fold(spark, tmp_path, rows):
    base = spark.createDataFrame([("a", "url_found", 0, None, None), ("b", "scraped", 3, None, None), ("c", "scraping", 2, "e", None)], BASE)
    first = [("a", 1, "scraping", 2, ""), ("a", 2, "scraped", 5, ""), ("a", 5, "failed_scrape", 0, "z"), ("b", 1, "failed_scrape", 0, "x")]
    second = [("a", 6, "failed_scrape", 0, "late"), ("a", 7, "scraped", 7, ""), ("b", 2, "scraped", 4, "")]
    stale = [("a", 3, "scraped", 100, ""), ("a", 4, "failed_scrape", 1, ""), ("q", 1, "scraped", 1, ""), ("q", 2, "failed_scrape", 1, "")]
    source, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    sent = []
    for part in (first, second):
        sent += part
        events(spark, part).write.mode("append").parquet(source)
        streamed, aside = folded(spark, base, source, out, log)
        assert rows(streamed) == rows(fold.fold_scrape_results(base, events(spark, sent))) and aside == set()
    events(spark, stale).write.mode("append").parquet(source)
    streamed, aside = folded(spark, base, source, out, log)
    assert {r.camis: r.item_count for r in streamed.collect()} == {"a": 14, "b": 7, "c": 2}
    assert aside == {("a", "late", 2), ("q", "unknown", 2)}


def test_random_results_by_stream_and_by_fold(spark, tmp_path, rows):
    draw = random.Random(4)
    names = [f"r{k}" for k in range(12)]
    base = spark.createDataFrame([(k, draw.choice(["url_found", "scraping", "scraped"]), draw.randrange(5), None, None) for k in names], BASE)
    kinds = ["failed_scrape"] * 5 + ["scraping", "url_found", "scraped"]
    sent = [(draw.choice(names[:3] * 5 + names), k, draw.choice(kinds), draw.randrange(9), draw.choice(["", "oops"])) for k in range(600)]
    source, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    for at in range(0, 600, 200):
        part = sent[at: at + 200]
        draw.shuffle(part)
        events(spark, part).write.mode("append").parquet(source)
        streamed, aside = folded(spark, base, source, out, log)
    assert rows(streamed) == rows(fold.fold_scrape_results(base, events(spark, sent))) and aside == set()
    assert spark.read.parquet(out).agg(F.sum("n")).first()[0] == 600  # thinned rows are counted


def test_failures_behind_a_success_do_not_travel():
    part = pd.DataFrame({"camis": ["a"] * 6 + ["b"], "seq": [6, 1, 2, 3, 4, 5, 1], "us": 0, "item_count": 1, "last_error": "",
                         "status": ["failed", "failed", "scraped", "failed", "scraped", "failed", "failed"], "n": 1})
    got = S.thin_results(part, "camis")
    assert list(zip(got["camis"], got["seq"], got["n"], strict=True)) == [("a", 1, 1), ("a", 2, 2), ("a", 4, 3), ("b", 1, 1)]


def test_repeated_batch_changes_nothing(spark, tmp_path, rows):
    root = str(tmp_path / "t")
    sink = J.index_sink(root, I.hashing_embedder(4))
    one = spark.createDataFrame([("r1", "a " * 900), ("r2", "b")], "review_id string, text string")
    sink(one, 0)
    before = rows(J.current_chunks(spark, root))
    sink(one, 0)
    assert rows(J.current_chunks(spark, root)) == before
    sink(spark.createDataFrame([("r1", "short now")], "review_id string, text string"), 1)
    got = rows(J.current_chunks(spark, root), "review_id", "chunk_text")
    assert got == [("r1", "short now"), ("r2", "b")]


def test_index_goes_on_where_it_stopped(spark, tmp_path):
    source, root, log = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "log")
    for rid in ("r1", "r2"):
        spark.createDataFrame([(rid, "text " + rid)], "review_id string, text string").write.mode("append").parquet(source)
        stream = J.file_stream(spark, source, "review_id string, text string")
        J.run_available(stream, J.index_sink(root, I.hashing_embedder(4)), log).awaitTermination()
    found = J.current_chunks(spark, root)
    assert sorted(r.chunk_text for r in found.collect()) == ["text r1", "text r2"]


def test_stream_replay_equals_batch_replay(spark, tmp_path, rows):
    restaurants = spark.createDataFrame([("i1", "50", "Queens", "Main St", "555")], "id string, camis string, boro string, address string, phone string")
    item = f"array<{schemas.MENU_ENTRY}>"
    data = [(k, "https://e.com/our-menu", "R", [{"dish_name": d}], "t") for k, d in (("50", "Soup"), ("50", "Soup"), ("x", "Soup"), ("50", "Tea"))]
    frame = spark.createDataFrame(data, f"business_id string, source_url string, restaurant_name string, items {item}, created_at string")
    source, root, bad = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "bad")
    frame.write.parquet(source)
    embed = I.hashing_embedder(4)
    sink = J.replay_sink(root, bad, restaurants, embed, 4)
    J.run_available(J.file_stream(spark, source, frame.schema), sink, str(tmp_path / "log")).awaitTermination()
    items, rejects = M.replay(frame, restaurants, embed, 4)
    columns = ["menu_item_id", "business_id", "dish_name", "city", "embedding"]
    schema = "menu_item_id string, business_id string, dish_name string, city string, embedding array<float>"
    assert rows(read_current(spark, root, schema, ["menu_item_id"]), *columns) == rows(items.dropDuplicates(["menu_item_id"]), *columns)
    assert spark.read.parquet(f"{bad}/batch=0").count() == rejects.count() == 1


def test_replay_sink_embeds_what_it_keeps(spark, tmp_path):
    """a dish named by many events is embedded a few times; of items with bad vectors the last good one stays."""
    asked = spark.sparkContext.accumulator(0)

    def embed(texts):
        asked.add(len(texts))
        return [None if "Null" in t else [1.0] * (3 if "Wide" in t else 2) for t in texts]

    restaurants = spark.createDataFrame([("i1", "50", "Queens", "Main St", "555")], "id string, camis string, boro string, address string, phone string")
    said = [("Soup", "plain", f"t{n:03d}") for n in range(400)] + [("Tea", "good", "t1"), ("Tea", "Wide", "t2"), ("Tea", "Null", "t3")]
    data = [("50", "https://e.com/our-menu", "R", [{"dish_name": dish, "description": text}], at) for dish, text, at in said]
    item = f"array<{schemas.MENU_ENTRY}>"
    frame = spark.createDataFrame(data, f"business_id string, source_url string, restaurant_name string, items {item}, created_at string")
    root, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    sink = J.replay_sink(root, bad, restaurants, embed, 2)
    for _ in range(2):  # a batch that runs again
        sink(frame.repartition(4), 0)
    schema = "menu_item_id string, dish_name string, description string, scraped_at string, embedding array<float>"
    kept = read_current(spark, root, schema, ["menu_item_id"]).collect()
    assert sorted((r.dish_name, r.description, r.scraped_at, list(r.embedding)) for r in kept) == [
        ("Soup", "plain", "t399", [1.0, 1.0]), ("Tea", "good", "t1", [1.0, 1.0])
    ]
    reasons = sorted(r.reason for r in spark.read.parquet(f"{bad}/batch=0").collect())
    assert reasons == ["missing vector", "vector has dim 3, expected 2"]
    assert 0 < asked.value <= 40


def test_replay_gathers_neither_texts_nor_restaurants(spark, tmp_path, monkeypatch):
    """a list of texts or restaurants that may be large in memory is not broadcast, whatever its compressed size."""
    for name in ("TINY_BYTES", "HELD_BYTES"):  # all is large
        monkeypatch.setattr(joins, name, 1, raising=False)
    facts = spark.createDataFrame([(f"i{n}", str(n), "Queens", "Main St", "555") for n in range(9)], "id string, camis string, boro string, address string, phone string")
    facts.write.parquet(str(tmp_path / "facts"))
    data = [(str(n % 9), "https://e.com/our-menu", "R", [{"dish_name": d}], f"t{n}") for n in range(30) for d in ("Soup", "Wide")]
    frame = spark.createDataFrame(data, f"business_id string, source_url string, restaurant_name string, items array<{schemas.MENU_ENTRY}>, created_at string")
    embed = lambda texts: [[1.0] * (3 if "Wide" in t else 2) for t in texts]
    items, bad = M.replay_last(frame, spark.read.parquet(str(tmp_path / "facts")), embed, 2, str(tmp_path / "texts"))
    for df in (items, bad):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert (items.count(), bad.count()) == (9, 30)


def test_mirror_gets_everything_in_order_in_the_end(spark, tmp_path):
    got, down = [], {1: 2, 3: 1}

    def mirror(batch, number):
        if down.get(number, 0):
            down[number] -= 1
            raise RuntimeError("mirror down")
        got.append((number, sorted(r.id for r in batch.collect())))

    path, root = str(tmp_path / "p"), str(tmp_path / "outbox")
    for number in range(6):
        if number == 3:  # a new process knows what waits
            sink = None
        sink = sink if number not in (0, 3) else J.dual_sink(J.batch_folder_sink(path), mirror, root)
        sink(spark.range(number * 10, number * 10 + 2), number)
    assert got == [(n, [n * 10, n * 10 + 1]) for n in range(6)]
    assert spark.read.parquet(path).count() == 12
    state = {r.number: (r.attempts, r.delivered) for r in J.outbox(spark, root).collect()}
    assert state == {1: (3, True), 2: (1, True), 3: (2, True)}


def test_primary_must_succeed_and_a_repeated_batch_is_sent_again(spark, tmp_path):
    def broken(batch, number):
        raise RuntimeError("down")

    with pytest.raises(RuntimeError):
        J.dual_sink(broken, J.batch_folder_sink(str(tmp_path / "m")), str(tmp_path / "o"))(spark.range(3), 1)
    J.dual_sink(J.batch_folder_sink(str(tmp_path / "p")), broken, str(tmp_path / "o"))(spark.range(3), 1)
    J.dual_sink(J.batch_folder_sink(str(tmp_path / "p")), J.batch_folder_sink(str(tmp_path / "m")), str(tmp_path / "o"))(spark.range(3), 1)
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3
    assert [(r.attempts, r.delivered) for r in J.outbox(spark, str(tmp_path / "o")).collect()] == [(2, True)]


def test_counts_follow_every_batch(spark, tmp_path, rows):
    draw = random.Random(8)
    base = spark.createDataFrame([(f"r{k}", draw.choice(["url_found", "scraping"]), k, None, None) for k in range(9)], BASE)
    start = C.totals(base, {"status": F.col("status")}, {"n": F.lit(1), "items": F.col("item_count")})
    source, root, log, out = (str(tmp_path / n) for n in ("in", "counts", "log", "out"))
    seq = 0
    for kinds in (["scraping"], ["failed_scrape", "url_found"], ["scraping", "url_found"], ["scraped", "failed_scrape"]):
        part = []
        for k in range(9):
            seq += 1
            part.append((f"r{k}", seq, draw.choice(kinds), draw.randrange(6), ""))
        events(spark, part).write.mode("append").parquet(source)
        changed = S.scrape_states(J.file_stream(spark, source, EVENT), base)
        sink, keep = C.differences_sink(root, C.status_differences), J.batch_folder_sink(out)
        J.run_available(changed, lambda b, n, s=sink, k=keep: (k(b, n), s(b, n)), log, "update").awaitTermination()
        full = S.with_states(base, spark.read.parquet(out))
        want = C.totals(full, {"status": F.col("status")}, {"n": F.lit(1), "items": F.col("item_count")})
        assert rows(C.current(start, root, ["status"], ["n", "items"])) == rows(want)


def test_daily_counts_and_unique_jobs(spark, tmp_path, rows):
    source = str(tmp_path / "in")
    days = spark.range(0, 10).select(
        (F.col("id") % 2).alias("k"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 40_000).alias("ts")
    )
    days.write.parquet(source)
    stream = J.file_stream(spark, source, "k long, ts timestamp")
    counts = J.daily_counts(stream, "ts")
    J.run_available(counts, J.batch_folder_sink(str(tmp_path / "c")), str(tmp_path / "log1"), "update").awaitTermination()
    got = rows(J.latest_values(spark, str(tmp_path / "c"), "day", "day STRING, n LONG"))
    batch = days.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).count()
    assert got == rows(batch)


def test_unique_jobs_and_late_ones(spark, tmp_path, rows):
    source, out, log = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "log")
    day = 86_400
    parts = [
        [("a", 10), ("a", 20), ("b", 5), (None, 7), (None, 8)],
        [("a", 6 * day), ("a", 8 * day), ("c", 30 * day)],  # the watermark passes the first weeks after this batch
        [("a", 9 * day), ("a", 9 * day + 1), ("d", 30 * day), ("c", 31 * day), ("x", None)],
    ]
    sent = []
    for part in parts:
        sent += part
        df = spark.createDataFrame(part, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts"))
        df.coalesce(1).write.mode("append").parquet(source)
        unique = S.unique_jobs(J.file_stream(spark, source, "k string, ts timestamp"), ["k"], "ts", 7 * day)
        J.run_available(unique, J.batch_folder_sink(out), log).awaitTermination()
    got = spark.read.parquet(out)
    every = spark.createDataFrame(sent, "k string, s long").select("k", F.timestamp_seconds("s").alias("ts")).filter("ts IS NOT NULL")
    twin = R.unique_in_period(every, ["k"], "ts", 7 * day)
    assert rows(got.filter("kind = 'job'"), "k", "period") == rows(twin, "k", "period")
    assert rows(got.filter("kind = 'late'"), "k", "period", "n") == [("a", 1, 2)]


def test_import_from_high_water_mark(spark):
    base = spark.createDataFrame([("2024-01-02 00:00:00",), (None,)], "u string").select(F.col("u").cast("timestamp").alias("updated_at"))
    source = spark.createDataFrame([("1", "2024-01-01 00:00:00"), ("2", "2024-01-03 00:00:00")], "camis string, t string").select("camis", F.col("t").cast("timestamp").alias("record_date"))
    assert [r.camis for r in J.since_high_water(source, base, "record_date", F.col("updated_at")).collect()] == ["2"]
    assert J.since_high_water(source, base.filter("false"), "record_date", F.col("updated_at")).count() == 2
    assert R.high_water(base.filter("false")).first().since.year == 1970


def test_unique_in_period(spark):
    df = spark.createDataFrame([("a", 10), ("a", 20), ("a", 700_000)], "k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = R.unique_in_period(df, ["k"], "ts", 604_800).orderBy("period").collect()
    assert [(r.k, r.merged) for r in got] == [("a", 2), ("a", 1)]


def test_text_turned_null_leaves_no_chunks(spark, tmp_path, rows):
    root, schema = str(tmp_path / "t"), "review_id string, text string"
    sink = J.index_sink(root, I.hashing_embedder(4))
    sink(spark.createDataFrame([("r1", "some words"), ("r2", "b")], schema), 0)
    sink(spark.createDataFrame([("r1", None)], schema), 1)
    assert rows(J.current_chunks(spark, root), "review_id", "chunk_text") == [("r2", "b")]
    sink(spark.createDataFrame([("r1", "back"), ("r2", "")], schema), 2)
    assert [r.chunk_text for r in J.current_chunks(spark, root).filter("chunk_text <> ''").collect()] == ["back"]


def test_state_is_opened_by_bucket_not_by_key(spark, tmp_path, rows, monkeypatch):
    source, log, out = (str(tmp_path / n) for n in ("in", "log", "out"))
    jobs = [(k, None if k % 7 else 0.0, (1 << 60) + k, k % 3) for k in range(300)] + [(1, float("nan"), None, 1)] * 2
    df = spark.createDataFrame(jobs, "a int, b double, c long, s long").withColumn("ts", F.timestamp_seconds("s"))
    df.write.parquet(source)
    for _ in range(2):  # the second run finds all of them given out
        unique = S.unique_jobs(J.file_stream(spark, source, df.schema), ["a", "b", "c"], "ts", 3600, buckets=2)
        query = J.run_available(unique, J.batch_folder_sink(out), log)
        query.awaitTermination()
        df.write.mode("append").parquet(source)
    got = spark.read.parquet(out)
    plain = lambda d: rows(d.select("a", F.col("b").cast("string"), "c"))
    assert plain(got) == plain(df.dropDuplicates(["a", "b", "c"])) and {r.period for r in got.collect()} == {0}
    assert got.filter("a = 1 AND isnan(b)").first().n == 2
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 8  # two buckets and their timers, not 301 keys


def test_differences_read_the_changes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    kind = "kind string, status string, item_count int, old_status string, old_item_count int"
    changed = spark.createDataFrame([("state", "scraped", 5, "scraping", 2), ("state", "scraping", None, None, None), ("late",) + (None,) * 4], kind)
    got = C.status_differences(changed.mapInPandas(count, kind)).collect()
    assert {(r.status, r.n, r["items"]) for r in got} == {("scraped", 1, 5), ("scraping", 0, -2), (None, -1, 0)} - {("scraping", 0, 0)}
    assert seen.value == 3
