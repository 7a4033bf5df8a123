import pytest
from pyspark.sql import functions as F

from dishlens import schemas
from dishlens.operators.filters import SearchFilter
from dishlens.plans import catalog as C, conversations as V, indexing as I, menus as M, regulatory as G, restaurants as R, search as S


def corpus(spark, reviews):
    """Chunks whose certainty against [1, 0] is the given number."""
    chunks, rows = [], []
    for i, (business, scores, stars) in enumerate(reviews):
        rid = f"r{i:02d}"
        rows.append((rid, business, f"name {business}", "Reno", "NV", "Food", stars, f"text of {rid}"))
        for j, s in enumerate(scores):
            chunks.append((f"{rid}-{j}", rid, f"chunk {j}", [s, (1 - s * s) ** 0.5]))
    return (
        spark.createDataFrame(chunks, "chunk_id string, review_id string, chunk_text string, embedding array<double>"),
        spark.createDataFrame(rows, "review_id string, business_id string, business_name string, city string, state string, categories string, stars double, text string"),
    )


def test_many_reviews_rank_below_one_better(spark):
    reviews = [("many", [s], 4.0) for s in (0.9, 0.8, 0.7, 0.6, 0.5, 0.1)] + [("one", [0.72, 0.2], 3.0)]
    chunks, table = corpus(spark, reviews)
    for rank in (S.rank_businesses, S.rank_businesses_overfetch):
        got = rank(chunks, table, [1.0, 0.0], 5).collect()
        assert [(r.business_id, round(r.score, 6)) for r in got] == [("one", 0.72), ("many", 0.70)]
    best = S.rank_businesses_max(chunks, table, [1.0, 0.0], 1).collect()
    assert [(r.business_id, round(r.score, 6)) for r in best] == [("many", 0.9)]


def test_overfetch_skips_blank_keys_and_averages_all_stars(spark):
    reviews = [("a", [0.9], 5.0)] + [("a", [0.8], 1.0)] * 5 + [("a", [0.1], 0.0), ("", [0.95], 5.0), (None, [0.99], 5.0)]
    chunks, table = corpus(spark, reviews)
    got = S.rank_businesses_overfetch(chunks, table, [1.0, 0.0], 5).collect()
    assert [(r.business_id, round(r.stars, 6)) for r in got] == [("a", round(10 / 6, 6))]


def test_reviews_keep_their_best_chunk(spark):
    chunks, table = corpus(spark, [("a", [0.2, 0.9], 5.0), ("b", [0.5], 5.0)])
    got = S.rank_reviews(chunks, table, [1.0, 0.0], 5).collect()
    assert [(r.review_id, r.chunk_text) for r in got] == [("r00", "chunk 1"), ("r01", "chunk 0")]
    only = S.rank_reviews(chunks, table, [1.0, 0.0], 5, SearchFilter(business_id="b")).collect()
    assert [r.review_id for r in only] == ["r01"]
    hybrid = S.hybrid_reviews(chunks, table, [1.0, 0.0], "r01", 5, 0.2).collect()
    assert [r.review_id for r in hybrid] == ["r01", "r00"]


@pytest.mark.parametrize("where, expected", [
    (SearchFilter(city="las"), {"1", "2"}), (SearchFilter(city="las%s"), {"1", "2"}), (SearchFilter(state="nv"), {"1", "3"}),
    (SearchFilter(category="bar"), {"1"}), (SearchFilter(city="Las Vegas", match="exact"), {"1"}),
    (SearchFilter(state="v", match="substring"), {"1", "3"}), (SearchFilter(category="bar", match="exact"), set()),
    (SearchFilter(), {"1", "2", "3"}),
])
def test_filters(spark, where, expected):
    df = spark.createDataFrame(
        [("1", "Las Vegas", "NV", "Bars, Food"), ("2", "LAS palmas", "ES", "Food"), ("3", "Reno", "NV", "Cafe")],
        "business_id string, city string, state string, categories string",
    )
    assert {r.business_id for r in df.filter(where.for_businesses()).collect()} == expected


def test_index_joins_chunks_and_embeds_in_order(spark):
    reviews = spark.createDataFrame([("r1", "b1", "one two " * 300), ("r2", "x", "short")], "review_id string, business_id string, text string")
    businesses = spark.createDataFrame([("b1", "One", "Reno", "NV", None)], schemas.BUSINESS)
    joined = I.joined_reviews(reviews, businesses)
    assert {(r.review_id, r.business_name, r.categories) for r in joined.collect()} == {("r1", "One", ""), ("r2", "", "")}
    assert I.joined_reviews(reviews, businesses, city="rENO").count() == 1
    chunks = I.index_batch(joined, I.hashing_embedder(8))
    embed = I.hashing_embedder(8)
    for row in chunks.collect():
        assert row.embedding == pytest.approx(embed([row.chunk_text])[0])
    assert I.review_vectors(chunks).count() == 2
    again = I.upsert_chunks(chunks, joined.filter("review_id = 'r1'"), I.index_batch(reviews.filter("review_id = 'r1'").withColumn("text", F.lit("now short")), embed))
    assert sorted((r.review_id, r.chunk_ix) for r in again.collect()) == [("r1", 0), ("r2", 0)]


def test_embedding_retries(tmp_path):
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return [[1.0] for _ in texts]

    assert I._patiently(flaky, ["a"], 0) == [[1.0]] and len(calls) == 3
    with pytest.raises(RuntimeError):
        I._patiently(lambda t: (_ for _ in ()).throw(RuntimeError("down")), ["a"], 0)


def test_whole_text_is_a_chunk_without_chunks(spark):
    reviews = spark.createDataFrame([("r1", "t1"), ("r2", "t2")], "review_id string, text string")
    chunks = spark.createDataFrame([("r1",)], "review_id string")
    vectors = spark.createDataFrame([("r1", [1.0]), ("r2", [2.0])], "review_id string, embedding array<float>")
    got = I.whole_text_chunks(reviews, chunks, vectors).collect()
    assert [(r.review_id, r.chunk_text, r.embedding) for r in got] == [("r2", "t2", [2.0])]


# ---------------------------------------------------------------- catalog

CATALOG = [
    ("garlic", "high", ["fructans"], "n", ["garlic oil"]), ("milk", "moderate", ["lactose", "GOS"], "n", ["oat"]),
    ("rice", "low", [], "n", []), ("onion", "high", ["fructans", "GOS"], "n", ["chives"]),
]
CATALOG_SCHEMA = "ingredient string, level string, groups array<string>, notes string, substitutions array<string>"


def test_rollup_takes_the_worst(spark):
    catalog = spark.createDataFrame(CATALOG, CATALOG_SCHEMA)
    items = spark.createDataFrame(
        [("p", 1, "Rice"), ("p", 2, " milk "), ("p", 3, "moon"), ("p", 4, "onion"), ("q", 1, "rice"), ("z", 1, "moon")],
        "product string, pos int, ingredient string",
    )
    matched = C.lookup(items, catalog, salt_by=["product", "pos"])
    got = {r["product"]: r for r in C.product_rollup(matched).collect()}
    assert got["p"].overall_level == "high" and got["p"].groups == ["lactose", "GOS", "fructans"] and got["p"].n_unknown == 1
    assert got["q"].overall_level == "low" and got["q"].groups == []
    assert got["z"].overall_level is None and got["z"].message and got["p"].message is None
    assert [tuple(r) for r in C.unknown_ingredients(matched).orderBy("product").collect()] == [("p", 3, "moon"), ("z", 1, "moon")]
    bare = C.products_without_ingredients(spark.createDataFrame([("p",), ("none",)], "product string"), items)
    assert [r["product"] for r in bare.collect()] == ["none"]


def test_nearest_entry_is_always_found_unless_a_threshold_says_no(spark):
    catalog = spark.createDataFrame(
        [("garlic", "high", ["fructans"], [1.0, 0.0]), ("rice", "low", [], [0.0, 1.0])], "ingredient string, level string, groups array<string>, embedding array<float>"
    )
    items = spark.createDataFrame([(1, "GARLIC", [0.0, 1.0]), (2, "leek", [0.9, 0.1]), (3, "odd", [-1.0, -0.9])], "item_id int, ingredient string, embedding array<float>")
    got = {r.item_id: r.matched for r in C.lookup(items, catalog, vectors=True).collect()}
    assert got == {1: "garlic", 2: "garlic", 3: "rice"}
    strict = {r.item_id: r.matched for r in C.lookup(items, catalog, vectors=True, threshold=0.5).collect()}
    assert strict == {1: "garlic", 2: "garlic", 3: None}


def test_catalog_merges_are_idempotent(spark, rows):
    as_of = F.lit("2024-06-01").cast("timestamp")
    base = spark.createDataFrame(CATALOG, CATALOG_SCHEMA).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    batch = spark.createDataFrame([("  Garlic ", "low", None, "x", None), ("leek", "high", ["fructans"], "x", None)], CATALOG_SCHEMA)
    seeded = C.seed(base, batch, as_of)
    assert rows(C.seed(seeded, batch, as_of)) == rows(seeded) and seeded.count() == 5
    assert seeded.filter("ingredient = 'garlic'").first().level == "high"
    reseeded = C.reseed(base, batch, as_of)
    garlic = reseeded.filter("ingredient = 'garlic'").first()
    assert (garlic.level, garlic.groups, garlic.substitutions, garlic.updated_at.month) == ("low", [], [], 6)
    assert rows(C.reseed(reseeded, batch, as_of)) == rows(reseeded)
    assert C.delete_entries(base, batch).count() == 3
    marker = C.seed_marker(spark.createDataFrame([], "key string, value string"), "1")
    assert rows(C.seed_marker(marker, "2")) == [("seeded", "2")]


def test_entry_validation(spark):
    cases = [
        ("Garlic", "high", ["fructans"], []), ("  ", "high", [], ["blank name"]), ("a\u0007", "low", [], ["control characters in name"]),
        ("é" * 101, "low", [], ["name above 200 bytes"]), ("a", "", [], ["blank level"]), ("a", "worse", [], ["unknown level"]),
        ("a", "low", ["GOS", "GOS"], ["repeated groups"]), ("a", "low", ["salt"], ["unknown group"]),
    ]
    df = spark.createDataFrame([(i, n, l, g) for i, (n, l, g, _) in enumerate(cases)], "i int, n string, l string, g array<string>")
    got = {r.i: r.e for r in df.select("i", C.entry_errors(F.col("n"), F.col("l"), F.col("g")).alias("e")).collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_tags(spark):
    df = spark.createDataFrame(
        [("q", 1, [], ["en:milk", "nuts"]), ("q", 2, ["en:red-onion", "en:red-onion", "en:salt"], ["en:milk"]), ("q", 3, ["en:late"], None)],
        "query string, pos int, ingredients_tags array<string>, allergens_tags array<string>",
    )
    assert C.product_ingredients(df).first().ingredients == ["red onion", "salt"]
    assert [r.allergen for r in C.allergens(df).orderBy("first").collect()] == ["milk", "nuts"]


# ---------------------------------------------------------------- restaurants and menus

def test_import_keeps_life_cycle_and_old_address(spark):
    row = {f.name: None for f in spark.createDataFrame([], schemas.RESTAURANT).schema}
    base = spark.createDataFrame([{**row, "id": "i1", "camis": "1", "dba": "Old", "address": "A", "status": "scraped", "item_count": 4}], schemas.RESTAURANT)
    batch = spark.createDataFrame([("1", "New"), ("2", "Two")], "camis string, dba string")
    batch = batch.withColumns({c: F.lit(None).cast("double" if c in ("latitude", "longitude") else "string") for c in R.IMPORT_COLUMNS if c != "dba"})
    got = {r.camis: r for r in R.upsert_inspected(base, batch).collect()}
    assert (got["1"].dba, got["1"].address, got["1"].status, got["1"].item_count, got["1"].id) == ("New", "A", "scraped", 4, "i1")
    assert got["2"].status == "pending_discovery" and len(got["2"].id) == 36


def test_failure_reasons(spark):
    df = spark.createDataFrame([("nothing at door 41 after 3 of 5 tries",), ("extract menu: x: 404",), ("y" * 100,)], "e string")
    got = [r[0] for r in df.select(R.failure_reason("e")).collect()]
    assert got == ["nothing at door N after N of N tries", "extract menu", "y" * 80]


def test_replay_finds_restaurants_by_either_key(spark):
    rid = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    stray = "6ba7b810-9dad-11d1-80b4-00c04fd430c9"
    restaurants = spark.createDataFrame([(rid, "50", "Queens", "Main St", None)], "id string, camis string, boro string, address string, phone string")
    item = {"dish_name": "Soup", "menu_section": ""}
    events = spark.createDataFrame(
        [(k, "https://e.com/our-menu", "R", [item], "t") for k in (rid, "50", stray, "nobody")],
        f"business_id string, source_url string, restaurant_name string, items array<{schemas.MENU_ENTRY}>, created_at string",
    )
    items, rejects = M.replay(events, restaurants, I.hashing_embedder(4), 4)
    got = sorted((r.business_id, r.city, r.state, r.menu_section) for r in items.collect())
    assert got == [(rid, "Queens", "NY", "our menu"), (rid, "Queens", "NY", "our menu"), (stray, "", "", "our menu")]
    assert [r.business_id for r in rejects.collect()] == ["nobody"]
    assert items.select("menu_item_id").distinct().count() == 2
    table = M.upsert_items(items.drop("item_pos").limit(0), items)
    assert table.count() == 2 and M.upsert_items(table, items).count() == 2


def test_job_errors_take_the_last(spark):
    jobs = spark.createDataFrame([(1, "k", "retryable", '{"camis": "50"}', '[{"error": "a"}, {"error": "b"}]'), (2, "k", "retryable", "{}", "[]")], "id int, kind string, state string, args string, errors string")
    got = [tuple(r) for r in R.job_errors(jobs, "k", "retryable", "camis").orderBy("id").collect()]
    assert got == [(1, "50", "b"), (2, None, None)]


# ---------------------------------------------------------------- regulatory

def test_rule_life_cycle(spark):
    rules = spark.createDataFrame(
        [("1", "a", "json:r", "proposed", None), ("2", "b", "json:r", "proposed", None), ("3", "c", "json:r", "active", "old"), ("4", "d", "json:r", "proposed", None)],
        "id string, domain string, selector string, status string, activated_at string",
    )
    good = '{"r": {"substance_name": "Red 3", "change_type": "addition"}}'
    checks = spark.createDataFrame([("1", good), ("2", "{}"), ("3", "{}")], "rule_id string, content string")
    settled = G.settle_rules(rules, G.verify_rules(rules, checks), F.lit("now"))
    assert {r.id: (r.status, r.activated_at) for r in settled.collect()} == {
        "1": ("active", "now"), "2": ("rejected", None), "3": ("active", "old"), "4": ("proposed", None),
    }
    pages = spark.createDataFrame([("c", "u1", good), ("a", "u2", good)], "domain string, url string, content string")
    got = {r.url: r.update for r in G.apply_rules(pages, rules).collect()}
    assert got["u1"].substance_name == "Red 3" and got["u2"] is None


def test_update_keeps_source_and_path(spark):
    schema = "id string, source_id string, cas_number string, raw_path string, description string, seq int"
    base = spark.createDataFrame([("1", "s", "c", "p", "old", 0)], schema)
    batch = spark.createDataFrame([("1", "S", "C", "P", "new", 2), ("1", "S", "C", "P", "newer", 3), ("2", "S", "C", "P", "add", 1)], schema)
    got = {r.id: tuple(r)[1:5] for r in G.upsert_updates(base, batch, "seq").collect()}
    assert got == {"1": ("s", "c", "p", "newer"), "2": ("S", "C", "P", "add")}


def test_proposed_rules_are_idempotent(spark, rows):
    base = spark.createDataFrame([], "id string, domain string, selector string, status string, provenance string, proposed_at string, activated_at string")
    batch = spark.createDataFrame([("a.gov", "json:x", "", "p")], "domain string, selector string, status string, provenance string")
    once = G.upsert_proposed_rules(base, batch, F.lit("t1"))
    twice = G.upsert_proposed_rules(once, batch, F.lit("t1"))
    assert rows(once) == rows(twice) and once.first().status == "proposed"


# ---------------------------------------------------------------- conversations

def test_transcript_concatenates_to_markdown(spark, tmp_path):
    conversations = spark.createDataFrame([("c1", "T", "Cafe", "Queens", "NY")], "id string, title string, business_name string, search_city string, search_state string").withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    messages = spark.createDataFrame([("c1", 2, "model", "hello"), ("c1", 1, "user", "hi"), ("c1", 3, "tool_call", "[]"), ("c1", 4, "system", "s")], "conversation_id string, sequence int, role string, content string")
    blocks = V.transcript_blocks(conversations, messages, F.lit("2024-02-03 04:05:06").cast("timestamp"))
    V.write_transcripts(blocks, str(tmp_path / "t"))
    text = "".join(r.block for r in spark.read.parquet(str(tmp_path / "t")).orderBy("part").collect())
    assert text == (
        "# T\n\n- **Conversation ID:** c1\n- **Business:** Cafe (Queens, NY)\n- **Created:** 2024-01-02T03:04:05Z\n"
        "- **Exported:** 2024-02-03T04:05:06Z\n\n---\n\n### 👤 User\n\nhi\n\n### 🤖 Assistant\n\nhello\n\n"
        "### 🔧 Tool Call\n\n```json\n[]\n```\n\n### System\n\ns\n\n"
    )


def test_history_drops_broken_tool_messages(spark):
    df = spark.createDataFrame([("c", 1, "tool_call", '[{"name": "f"}]'), ("c", 2, "tool_call", "{}"), ("c", 3, "tool_response", "x"), ("c", 4, "user", "{"), ("c", 5, "tool_response", "null")], "conversation_id string, sequence int, role string, content string")
    got = [(r.sequence, r.role, r.text, r.function_calls, r.function_results) for r in V.model_history(df).orderBy("sequence").collect()]
    assert got == [(1, "model", "", ['{"name":"f"}'], []), (4, "user", "{", [], []), (5, "user", "", [], [])]


def test_no_users_means_zero_per_user(spark):
    conversations = spark.createDataFrame([(1,)], "id int")
    users = spark.createDataFrame([("deleted",)], "status string")
    assert tuple(V.conversation_analytics(conversations, users).first()) == (1, 0.0)


def test_digest(spark):
    df = spark.createDataFrame([("b", "Cafe", "r1", 3.5, "ok", 0.5), ("b", "Cafe", "r2", 5.0, "great", 0.9), ("b", "Cafe", "r3", 1.0, "bad", 0.1)], "business_id string, business_name string, review_id string, stars float, text string, score double")
    assert V.review_digest(df, 2).first().digest == "Here's what 2 customers are saying about Cafe:\n\n1. ★★★★★\ngreat\n\n2. ★★★½\nok\n\n"


def test_later_event_wins_an_item(spark):
    base = spark.createDataFrame([("i", "stored")], "menu_item_id string, dish_name string")
    batch = spark.createDataFrame(
        [("i", "old", "2024-01-01", 5), ("i", "new", "2024-06-01", 1)],
        "menu_item_id string, dish_name string, scraped_at string, item_pos int",
    )
    assert [r.dish_name for r in M.upsert_items(base, batch).collect()] == ["new"]


def test_item_merge_carries_only_what_the_table_holds(spark):
    """columns the table lacks are neither sorted nor shuffled."""
    base = spark.createDataFrame([("i", "old")], "menu_item_id string, dish_name string")
    batch = spark.createDataFrame(
        [("i", "first", "2024-01-01", 5, "long"), ("i", "last", "2024-06-01", 1, "long"), ("j", "other", None, 1, "long")],
        "menu_item_id string, dish_name string, scraped_at string, item_pos int, unused_text string",
    )
    merged = M.upsert_items(base, batch)
    assert sorted(tuple(r) for r in merged.collect()) == [("i", "last"), ("j", "other")]
    assert "Sort" in (plan := merged._jdf.queryExecution().sparkPlan().toString())
    assert "unused_text" not in "".join(line for line in plan.splitlines() if "Window" in line or "Project" in line)


def test_equal_texts_are_embedded_once_a_task(spark):
    """repeated texts take the vector they got; vectors of any width, or none, come through; the store is bounded."""
    import pyarrow as pa

    asked: list[str] = []

    def embed(texts):
        asked.extend(texts)
        return [None if t == "none" else [float(len(t))] * (1 + len(t) % 2) for t in texts]

    columns = [pa.array(["a", "bb", None, "a"]), pa.array(["none", "bb"]), pa.array([], pa.string()), pa.array(["bb"])]
    got = [c.to_pylist() for c in I._embed_texts(iter(columns), embed, 2, 0.0)]
    assert got == [[[1.0, 1.0], [2.0], [0.0], [1.0, 1.0]], [None, [2.0]], [], [[2.0]]]
    assert sorted(asked) == ["", "a", "bb", "none"]
    asked.clear()
    got = [c.to_pylist() for c in I._embed_texts(iter(columns), embed, 2, 0.0, cells=0)]
    assert got[-1] == [[2.0]] and asked.count("bb") == 3


def test_urls_chosen_in_rows_as_from_rows(spark, rows):
    from dishlens.plans import discovery

    answers = [
        '{"website_url": "https://a.com/", "menu_urls": ["https://a.com", " https://a.com/menu/ ", "https://doordash.com/a", "https://a.com/card"]}',
        '{"website_url": "", "menu_urls": ["https://doordash.com/b", "https://doordash.com/b/"]}', "see https://c.com/x and https://c.com/x/", "none", "", None,
    ]
    given = spark.createDataFrame(list(enumerate(answers)), "camis int, response_text string")
    answered = discovery.parse_answers(given)
    sites = answered.selectExpr("camis", "coalesce(answer.website_url, '') AS website_url")
    want = discovery.select_urls(discovery.candidate_urls(answered), sites)
    got = discovery.select_answer_urls(answered)
    assert rows(got) == rows(want) and got.count() == len(answers)
    assert [r.menu_urls for r in got.orderBy("camis").collect()][1] == ["https://doordash.com/b"]


def test_an_id_counts_before_a_public_number(spark, rows):
    from dishlens.plans import menus

    shops = spark.createDataFrame(
        [("i1", "c1", "B1", None, "p"), ("c1", "c2", "B2", "A2", None), ("i3", None, "B3", "A3", "q")],
        "id string, camis string, boro string, address string, phone string",
    )
    events = spark.createDataFrame([("c1", "u"), ("c2", "u"), ("i1", "u"), ("zz", "u"), (None, "u")], "business_id string, source_url string")
    good, bad = menus.enrich_events(events, shops)
    assert rows(good, "business_id", "city", "address") == [("c1", "B2", "A2"), ("c1", "B2", "A2"), ("i1", "B1", "")]
    assert bad.count() == 2
