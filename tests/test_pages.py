import json

import pytest
from pyspark.sql import functions as F

from dishlens.functions import html as H, jsonsel, urls as U
from dishlens.functions.jsonld import with_jsonld
from dishlens.plans import discovery as D, pages as P


def ld(value):
    text = value if isinstance(value, str) else json.dumps(value)
    return f'<html><head><script type="application/ld+json">{text}</script></head><body>x</body></html>'


def extract(spark, html):
    row = with_jsonld(spark.createDataFrame([(html,)], "html string")).first()
    return [i.asDict() for i in row["items"]], row["meta"], row["jsonld_hit"]


def test_menu_with_sections_prices_and_ingredients(spark):
    menu = {"@type": "Menu", "hasMenuSection": [{"hasMenuItem": [
        {"@type": "MenuItem", "name": "Pasta", "description": "d", "offers": {"price": "14.50"}, "ingredients": ["flour", 3, "egg"]},
        {"name": "Soup", "offers": {"price": 9}}, {"description": "nameless"}, {"name": 5}, "text",
    ]}], "hasMenuItem": [{"name": "Bread", "recipeIngredient": "flour", "offers": {"price": "n/a"}}]}
    items, meta, hit = extract(spark, ld(menu))
    assert hit and [i["dish_name"] for i in items] == ["Pasta", "Soup", "Bread"]
    assert [i["price"] for i in items] == [14.5, 9.0, None]
    assert [i["stated_ingredients"] for i in items] == [["flour", "egg"], [], ["flour"]]
    assert [i["has_full_ingredients"] for i in items] == [True, False, True]
    assert tuple(meta) == ("", "", "")


def test_restaurant_facts_and_graph(spark):
    place = {"@type": "Restaurant", "name": "R", "address": {"addressLocality": "Astoria", "addressRegion": "NY"}}
    items, meta, hit = extract(spark, ld({"@graph": [{"@type": "WebSite", "name": "w"}, place]}))
    assert not hit and tuple(meta) == ("R", "Astoria", "NY") and items == []
    items, meta, hit = extract(spark, ld([{**place, "hasMenu": {"hasMenuItem": [{"name": "a"}]}}, {"@type": "Thing"}]))
    assert hit and meta.restaurant_name == "R"


def test_last_node_decides_without_a_name(spark):
    one = {"@type": "Bakery", "address": {"addressLocality": "X"}}
    assert extract(spark, ld([one, {"@type": "Cafe"}]))[1].city == ""
    assert extract(spark, ld([{"@type": "Cafe"}, one]))[1].city == "X"


@pytest.mark.parametrize("html", ["<p>none</p>", ld("{broken"), ld("[]"), "", '<script type="text/json">{"@type":"MenuItem","name":"a"}</script>'])
def test_no_items(spark, html):
    assert extract(spark, html)[2] is False


def test_markdown_structure():
    page = H.parse_page(
        "<html><head><title>skip</title></head><body><nav>skip</nav><h1>Menu</h1><h4>Sub</h4><ul><li>One<li>Two</ul>"
        "<div>Div</div><script>skip()</script><button>Burger $5</button><noscript>skip</noscript></body></html>"
    )
    lines = [line.strip() for line in page["markdown"].split("\n") if line.strip()]
    assert lines == ["# Menu", "#### Sub", "- One", "- Two", "Div", "- Burger $5"]
    assert "skip" not in page["markdown"]


def test_page_without_head_or_body_tags():
    assert H.parse_page("<title>t</title><p>x<p>y")["markdown"] == "\nx \n\ny \n"


def images(spark, html, url="https://e.com/dir/"):
    df = spark.createDataFrame([(1, url, html)], "id int, url string, html string")
    found = P.menu_images(P.with_page(df), "id").orderBy("rank").collect()
    return [(r.image_url, r.score) for r in found]


def test_image_scores(spark):
    assert images(spark, '<img src="menu.jpg" width="900">') == [("https://e.com/dir/menu.jpg", 6)]
    assert images(spark, '<img src="hero.jpg" width="1200">') == []
    assert images(spark, '<img src="p.jpg" width="1200">') == []
    assert images(spark, '<img src="/p.jpg" srcset="a 1x, b 1024w" alt="">') == [("https://e.com/p.jpg", 4)]
    assert images(spark, '<div id="our-Menu"><img data-src="p.png" alt="Menu"></div>') == [("https://e.com/dir/p.png", 4)]
    assert images(spark, '<nav><img src="menu.jpg" width="900"></nav>') == []
    assert images(spark, '<img src="menu.svg" width="900">') == []
    assert images(spark, '<img src="menu.jpg" width="50" alt="menu">') == []
    assert images(spark, '<img src="menu-logo.jpg" width="900" alt="menu">') == []


def test_images_best_first(spark):
    html = '<img src="a-menu.jpg" width=800 height=10><img src="b-menu.jpg" width=900 height=900><img src="c-menu.jpg" alt="menu" width=900>'
    assert [u[-10:] for u, _ in images(spark, html)] == ["c-menu.jpg", "b-menu.jpg", "a-menu.jpg"]


def test_url_classes(spark):
    df = spark.createDataFrame([(u,) for u in (
        "https://www.hilton.com/x", "https://nothilton.com", "https://corner.dine.online/", "https://www.yelp.com/biz/a",
        "https://www.google.com/maps/place", "https://google.com/search", "nonsense",
    )], "u string")
    got = [tuple(r) for r in df.select(U.is_blocked("u"), U.is_ordering("u"), U.is_delivery("u")).collect()]
    assert got == [
        (True, False, False), (False, False, False), (False, True, False), (False, False, True),
        (False, False, True), (False, False, False), (False, False, False),
    ]


@pytest.mark.parametrize("host, private", [
    ("localhost", True), ("10.1.2.3", True), ("172.15.0.1", False), ("172.16.0.1", True), ("172.31.9.9", True),
    ("172.32.0.1", False), ("192.168.1.1", True), ("192.169.1.1", False), ("127.0.0.1", True), ("169.254.169.254", True),
    ("8.8.8.8", False), ("10.1.2.300", False), ("::1", True), ("[fd12::1]", True), ("fe80::1", False), ("10.example.com", False),
    ("::ffff:10.0.0.1", True), ("2001:db8::1", False),
])
def test_private_hosts(spark, host, private):
    got = spark.range(1).select(U.is_private_host(F.lit(host)).alias("p")).first().p
    assert got is private


def test_registrable_domain_and_section(spark):
    df = spark.createDataFrame([("www.example.com",), ("a.b.example.com:8080",), ("localhost",), ("Menu.Example.COM",)], "h string")
    assert [r[0] for r in df.select(U.registrable_domain("h")).collect()] == ["example.com", "example.com", "localhost", "example.com"]
    df = spark.createDataFrame([("https://e.com/our-menu/lunch-specials/",), ("https://e.com",), ("https://e.com/a%20b-c?x",)], "u string")
    assert [r[0] for r in df.select(U.menu_section("u")).collect()] == ["lunch specials", "", "a b c"]


def decide(spark, url, status, primary, html):
    df = spark.createDataFrame([(url, status, primary, html)], "url string, status int, primary_url string, html string")
    return D.check_pages(df).first().decision


def test_signal_decisions(spark):
    menu = "<p>Menu $1.00 $2.00 $ 3</p>"
    assert decide(spark, "https://x.toasttab.com", 404, "", "") == "keep: ordering platform"
    assert decide(spark, "http://127.0.0.1/menu", 200, "", menu) == "drop: private host"
    assert decide(spark, "https://e.com", 404, "https://e.com/", menu) == "drop: gone"
    assert decide(spark, "https://e.com/", 200, "https://e.com", "") == "keep: primary site"
    assert decide(spark, "https://e.com/a", 503, "", "") == "keep: blocked"
    assert decide(spark, "https://e.com/a", 200, "", menu) == "keep: menu signal"
    assert decide(spark, "https://e.com/a", 200, "", "<p>menu $1 $2</p>") == "drop: no signal"
    assert decide(spark, "https://e.com/a", None, "", "") == "keep: fetch failed"


def test_sub_links(spark):
    html = (
        '<a href="/menu">1</a><a href="/menu/">2</a><a href="#menu">3</a><a href="https://other.com/menu">4</a>'
        '<a href="mailto:menu@e.com">5</a><a href="https://shop.e.com/lunch?x=1#y">6</a><a href="/about">7</a><a href="f.pdf">8</a>'
    )
    df = spark.createDataFrame([(1, "https://www.e.com/", html)], "id int, url string, html string")
    got = [r.link for r in D.sub_links(P.with_page(df), "id").orderBy("pos").collect()]
    assert got == ["https://www.e.com/menu", "https://shop.e.com/lunch?x=1", "https://www.e.com/f.pdf"]


def test_answers_fall_back_to_urls_in_text(spark):
    df = spark.createDataFrame([
        (1, '```json\n{"website_url": "https://a.com/", "menu_urls": ["https://a.com/menu", "https://www.zillow.com/x"]}\n```'),
        (2, 'Try https://b.com/menu) or "https://c.com".'), (3, '{"menu_urls": [1], "x": "https://d.com"}'), (4, "null"),
    ], "camis int, response_text string")
    rows = D.candidate_urls(D.parse_answers(df)).orderBy("camis", "pos").collect()
    got = {}
    for r in rows:
        got.setdefault(r.camis, []).append(r.url)
    assert got == {
        1: ["https://a.com/", "https://a.com/menu", "https://a.com/menus"],
        2: ["https://b.com/menu", "https://c.com"], 3: ["https://d.com"],
    }


def test_routes(spark):
    long = "<p>" + "a long enough line of menu text here. " * 10 + "</p>"
    pages = [
        ("application/pdf", ""), ("text/html", ld({"@type": "MenuItem", "name": "a"})), ("text/html", "<script src=a></script>hi"),
        ("text/html", "<p>short</p><img src=menu.png width=900>"), ("text/html", "<p>short</p>"), ("text/html", long),
    ]
    df = spark.createDataFrame([(i, "https://e.com", c, h) for i, (c, h) in enumerate(pages)], "id int, url string, content_type string, html string")
    got = [r.route for r in P.route_pages(df).orderBy("id").collect()]
    assert got == ["pdf", "jsonld", "webagent", "image_ocr", "refuse", "html_llm"]
    off = [r.route for r in P.route_pages(df, renderer=False, vision=False, adapter=True).orderBy("id").collect()]
    assert off == ["pdf", "jsonld", "webagent", "webagent", "webagent", "html_llm"]


@pytest.mark.parametrize("content, selector, picked", [
    ('{"results": {"a": 1}}', "json:results", '{"a":1}'), ('{"x": null}', "json:x", "null"), ('{"x": 1}', "json:y", ""),
    ("[1]", "json:x", ""), ("text", "", "text"), ("<p>", "div.x", ""), ("broken", "json:x", ""), ('{"a\'b": "v"}', "json:a'b", '"v"'),
])
def test_selectors(spark, content, selector, picked):
    df = spark.createDataFrame([(content, selector)], "c string, s string")
    assert df.select(jsonsel.select_json("c", "s").alias("p")).first().p == picked


def test_structured_update_needs_substance_and_change(spark):
    df = spark.createDataFrame([('{"substance_name": "Red 3", "change_type": "revocation"}',), ('{"substance_name": "x"}',), ("[]",), ("x",)], "c string")
    got = [r.u for r in df.select(jsonsel.structured_update("c").alias("u")).collect()]
    assert got[0].substance_name == "Red 3" and got[0].cas_number == "" and got[1:] == [None, None, None]


def test_unclosed_tags_take_linear_time():
    import time

    from dishlens.functions import html

    start = time.process_time()
    assert "x" in html.parse_page("<b><div><li><td>" * 10_000 + "x")["markdown"]
    assert time.process_time() - start < 3


def test_large_pages_are_parsed_a_few_at_a_time(spark):
    """the parser's batches of (page, url) are bounded by bytes."""
    import pandas as pd

    @F.pandas_udf("long")
    def together(pages: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([len(pages)] * len(pages))

    pages = spark.range(400, numPartitions=1).select(F.repeat(F.lit("<a href=/x>y</a>"), 6_000).alias("html"), F.lit("http://e.com").alias("url"))
    assert pages.select(F.max(together("html", "url"))).first()[0] < 100


def test_rows_of_few_pages_are_held_at_once(monkeypatch):
    """a batch's pages become Arrow columns a few at a time, with the rows of one page by itself."""
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(H, "HELD", 20_000)
    texts = ["<p>é</p><div id=menu><img src=m.png srcset='a 900w' alt=''></div>" + f"<a href=/{k}?x#y>y</a>" * 1_000 for k in range(30)] + [None, ""]
    bases = ["http://e.com/"] * 31 + [None]
    got = H.parse_pages(pa.array(texts), pa.array(bases))
    assert got.to_pylist() == [H.parse_page(t or "", b) for t, b in zip(texts, bases)]
    assert H.parse_pages(pa.array([], "string"), pa.array([], "string")).to_pylist() == []
    peaks = []
    for held in (20_000, 10**9):
        monkeypatch.setattr(H, "HELD", held)
        tracemalloc.start()
        H.parse_pages(pa.array(texts), pa.array(bases))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[0] < peaks[1] / 4
