"""Page analytics: url features, signals, JSON-LD, images, links, routing; over pages, documents and
pages Spark builds from parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dishlens.constants import PAGE_CLASSES
from dishlens.functions import keys, text as X, urls as U
from dishlens.functions.jsonld import with_jsonld
from dishlens.functions.urls import ordering_links as links_in
from dishlens.operators.dedup import distinct_urls
from dishlens.operators.spread import spread_small
from dishlens.plans import discovery as D, pages as P
from dishlens.suite.base import query, table

# ---------------------------------------------------------------- urls

# Every page url, plus one url per page on a host that some list knows.
_HOSTED = (
    "CASE page_id % 9 WHEN 0 THEN 'https://order.toasttab.com/r-' || page_id || '/our-menu/' "
    "WHEN 1 THEN 'http://10.0.' || (page_id % 250) || '.1/menu' WHEN 2 THEN 'https://www.Yelp.com/biz/x-' || page_id "
    "WHEN 3 THEN 'https://sub.hilton.com/dinner-menu?x=' || page_id WHEN 4 THEN 'http://172.20.1.2:8080/a/b-c' "
    "WHEN 5 THEN 'https://r' || page_id || '.square.site' WHEN 6 THEN 'http://192.169.0.1/lunch-menu#top' "
    "WHEN 7 THEN 'https://nothilton.com/food/' ELSE 'http://localhost/x' END"
)
_URLS = f"""
urls AS (
  SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, {_HOSTED} FROM pages),
hosts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM urls)"""


def _urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    hosted = pages.selectExpr("page_id + 1000000000 AS page_id", f"{_HOSTED} AS url")
    return pages.select("page_id", "url").unionByName(hosted)


@query(f"""
WITH {_URLS}
SELECT page_id, host, path, replace(split_part(regexp_replace(path, '^/+|/+$', '', 'g'), '/', -1), '-', ' ') AS section,
  regexp_replace(host, '^www\\.', '') AS bare,
  array_to_string(list_slice(string_split(regexp_replace(host, '^www\\.', ''), '.'), -2, -1), '.') AS domain
FROM hosts
""")
def url_features(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select(
        "page_id", U.host("url").alias("host"), U.path("url").alias("path"),
        U.menu_section("url").alias("section"),
        F.regexp_replace(U.host("url"), r"^www\.", "").alias("bare"),
        U.registrable_domain(U.host("url")).alias("domain"),
    )


@query(f"""
WITH {_URLS}
SELECT page_id,
  (host = 'hilton.com' OR host LIKE '%.hilton.com') AS blocked,
  (host LIKE '%.toasttab.com' OR host LIKE '%.square.site') AS ordering,
  contains(lower(url), 'yelp.com') AS delivery,
  (host LIKE '10.%' OR host LIKE '172.20.%' OR host = 'localhost') AS private
FROM hosts
""")
def host_class(spark: SparkSession, sf: str) -> DataFrame:
    return _urls(spark, sf).select(
        "page_id", U.is_blocked("url").alias("blocked"), U.is_ordering("url").alias("ordering"),
        U.is_delivery("url").alias("delivery"), U.is_private_host(U.host("url")).alias("private"),
    )


@query(f"""
WITH {_URLS}
SELECT page_id, CASE WHEN host <> 'localhost' AND host NOT LIKE '172%' AND page_id % 2 = 0 THEN 'other host'
  WHEN host LIKE '10.%' OR host LIKE '172.20.%' OR host = 'localhost' THEN 'private host' END AS error
FROM hosts
""")
def api_url_check(spark: SparkSession, sf: str) -> DataFrame:
    urls = _urls(spark, sf)
    local = U.host("url").isin("localhost") | U.host("url").startswith("172")
    other = F.when(~local & (F.col("page_id") % 2 == 0), F.lit("elsewhere.com")).otherwise(U.host_port("url"))
    return urls.select("page_id", U.api_url_error("url", other).alias("error"))


@query("""
WITH u AS (
  SELECT user_id, event_id AS pos, ' https://e.com/' || (event_id % 23) || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END AS url FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, regexp_replace(trim(url), '/$', '') ORDER BY pos) AS rn FROM u)
SELECT user_id, pos, url FROM r WHERE rn = 1
""")
def url_dedup(spark: SparkSession, sf: str) -> DataFrame:
    urls = table(spark, sf, "events").selectExpr(
        "user_id", "event_id AS pos",
        "' https://e.com/' || (event_id % 23) || CASE WHEN event_id % 3 = 0 THEN '/' ELSE '' END AS url",
    )
    return distinct_urls(urls, "user_id", "url", "pos")


# ---------------------------------------------------------------- keys and texts

def uuid_sql(namespace: str, name: str) -> str:
    digest = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return (
        f"substr({digest}, 1, 8) || '-' || substr({digest}, 9, 4) || '-5' || substr({digest}, 14, 3) || '-' || "
        f"translate(substr({digest}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({digest}, 18, 3) || '-' || "
        f"substr({digest}, 21, 12)"
    )


@query(f"""
SELECT doc_id, {uuid_sql(keys.NS_OID, "CAST(doc_id AS VARCHAR)")} AS review_key,
  {uuid_sql(keys.NS_OID, "doc_id || '_chunk_' || n_chars")} AS chunk_key,
  {uuid_sql(keys.NS_URL, "text")} AS text_key,
  {uuid_sql(keys.NS_MENU_ITEM, "doc_id || '|' || source || '|' || lang")} AS item_key
FROM documents
""")
def uuid5_keys(spark: SparkSession, sf: str) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf, "documents").select(
        "doc_id", keys.review_key(doc_id).alias("review_key"),
        keys.chunk_key(doc_id, F.col("n_chars")).alias("chunk_key"),
        keys.source_key("text").alias("text_key"),
        keys.menu_item_key(doc_id, F.col("source"), F.col("lang")).alias("item_key"),
    )


_SPACES = r"[ \t\r\f\v\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


@query(f"""
WITH l AS (
  SELECT doc_id, regexp_replace(unnest(string_split(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr(10)) ELSE text END, chr(10))),
         '^{_SPACES}+|{_SPACES}+$', '', 'g') AS line FROM documents),
c AS (SELECT doc_id, count(*) FILTER (WHERE line <> '') AS total, count(*) FILTER (WHERE line <> '' AND length(line) <= 20) AS short
      FROM l GROUP BY 1)
SELECT doc_id, total >= 20 AND short::DOUBLE / total > 0.7 AS noisy FROM c
""")
def noise_flags(spark: SparkSession, sf: str) -> DataFrame:
    markdown = F.when(
        F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))
    ).otherwise(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.coalesce(X.is_noisy(markdown), F.lit(False)).alias("noisy")
    )


@query("""
WITH p AS (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN html || repeat(' <i></i>', 40000) ELSE html END AS html,
         CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'x' WHEN 2 THEN repeat(url, 12) ELSE repeat(url, 2) END AS md FROM pages)
SELECT page_id, length(md) < 500 AND ((length(md) < 60 AND contains(html, '<script'))
  OR (strlen(html) >= 50000 AND strlen(html) // greatest(length(md), 1) > 500)) AS shell FROM p
""")
def js_shell(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").selectExpr(
        "page_id", "CASE page_id % 4 WHEN 0 THEN html || repeat(' <i></i>', 40000) ELSE html END AS html",
        "CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'x' WHEN 2 THEN repeat(url, 12) ELSE repeat(url, 2) END AS md",
    )
    return pages.select("page_id", X.is_script_shell("md", "html").alias("shell"))


@query("""
WITH cut AS (
  SELECT doc_id, text, list_max(list_filter(range(0, 801), lambda i: strlen(left(text, i)) <= 800)) AS whole FROM documents)
SELECT doc_id, md5(substring(text, 1, 300)) AS head,
  md5(left(text, whole) || CASE WHEN strlen(text) > 800 AND strlen(left(text, whole)) < 800 THEN chr(65533) ELSE '' END) AS head_bytes FROM cut
""")
def truncate_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(X.truncate_runes("text", 300)).alias("head"), F.md5(X.truncate_bytes("text", 800)).alias("head_bytes")
    )


@query("""
WITH cut AS (
  SELECT doc_id, text, strlen(text) AS size,
    list_max(list_filter(range(0, 2001), lambda i: strlen(left(text, i)) <= 2000)) AS whole FROM documents)
SELECT doc_id, md5('<untrusted_input>' || chr(10) || left(text, whole) ||
  CASE WHEN size > 2000 AND strlen(left(text, whole)) < 2000 THEN chr(65533) ELSE '' END || chr(10) || '</untrusted_input>') AS wrapped FROM cut
""")
def wrap_for_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(X.wrap_untrusted("text", 500)).alias("wrapped"))


# ---------------------------------------------------------------- page parsing

@query()
def html_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_page(table(spark, sf, "pages")).select("page_id", "markdown")


def _part_page(name: Column, brand: Column, price: Column) -> Column:
    return F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), name, F.lit("</title><style>p{}</style></head><body><nav><a href='/x'>no</a></nav><h1>"),
        name, F.lit("</h1><div>Our &amp; <b>"), brand, F.lit("</b></div><ul><li>one<li>"), name,
        F.lit("</ul><script>var x = '<p>';</script><p>Price $"), price.cast("string"),
        F.lit("<p>Next<table><tr><td>c</td></tr></table><button>Buy "), brand,
        F.lit("</button><footer>end</footer></body></html>"),
    )


@query("""
WITH t AS (SELECT *, CAST(p_size AS VARCHAR) AS price FROM part)
SELECT p_partkey, chr(10) || '# ' || p_name || ' ' || chr(10) || chr(10) || 'Our & ' || p_brand || ' ' || chr(10) || '- one ' || chr(10) ||
  chr(10) || '- ' || p_name || ' ' || chr(10) || chr(10) || 'Price $' || price || ' ' || chr(10) || chr(10) || 'Next ' || chr(10) || chr(10) ||
  'c ' || chr(10) || chr(10) || '- Buy ' || p_brand || ' ' || chr(10) AS markdown FROM t
""")
def html_to_markdown_parts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "part").select(
        "p_partkey", F.lit("http://e.com").alias("url"),
        _part_page(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("html"),
    )
    return P.with_page(pages).select("p_partkey", "markdown")


def _menu_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per part with a JSON-LD menu: a section with the part and a nameless item, an item of
    the menu itself, prices as text or number, ingredient lists on some items, broken and empty blocks."""
    named = F.when(F.col("p_partkey") % 10 > 0, F.concat("p_name", F.lit(" "), "p_partkey"))
    item = F.struct(
        F.lit("MenuItem").alias("@type"), named.alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("description"),
        F.when(F.col("p_partkey") % 3 == 0, F.struct(F.format_string(" %.2f ", "p_retailprice").alias("price"))).alias("offers"),
        F.when(F.col("p_partkey") % 4 == 0, F.array("p_type", "p_brand")).alias("ingredients"),
        F.when(F.col("p_partkey") % 4 == 1, F.col("p_brand")).alias("recipeIngredient"),
    )
    own = F.struct(F.lit("own").alias("name"), F.struct(F.col("p_size").alias("price")).alias("offers"))
    nameless = F.struct(F.lit(7).alias("name"))
    sections = F.array(
        F.struct(F.array(item).alias("hasMenuItem")), F.struct(F.array(item.withField("name", F.lit(""))).alias("hasMenuItem")),
    )
    menu = F.struct(
        F.lit("Menu").alias("@type"), sections.alias("hasMenuSection"),
        F.array(own).alias("hasMenuItem"), F.array(nameless).alias("other"),
    )
    place = F.struct(
        F.lit("Restaurant").alias("@type"), F.concat(F.lit("Shop "), "p_brand").alias("name"),
        F.struct(F.lit("Astoria").alias("addressLocality"), F.lit("NY").alias("addressRegion")).alias("address"),
    )
    block = F.when(
        F.col("p_size") % 3 == 0, F.to_json(F.struct(F.array(place).alias("@graph")))
    ).when(F.col("p_size") % 3 == 1, F.to_json(menu)).otherwise(F.lit("{broken"))
    second = F.when(F.col("p_size") % 3 == 0, F.to_json(menu)).otherwise(F.lit("[]"))
    html = F.concat(
        F.lit("<html><head><!-- <script type='application/ld+json'>{\"@type\":\"MenuItem\",\"name\":\"hidden\"}</script> -->"
              "<script type=\"application/ld+json\">"), block,
        F.lit("</script><script>var x;</script></head><body>x<SCRIPT data-a=1 TYPE='Application/LD+JSON'>"), second,
        F.lit("</SCRIPT></body></html>"),
    )
    return table(spark, sf, "part").select("p_partkey", html.alias("html"))


_LD_ITEMS = """
ld AS (
  SELECT p_partkey, p_brand, p_size, p_name || ' ' || p_partkey AS dish_name,
    CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS description,
    CASE WHEN p_partkey % 3 = 0 THEN round(p_retailprice, 2) END AS price,
    CASE p_partkey % 4 WHEN 0 THEN p_type || ',' || p_brand WHEN 1 THEN p_brand ELSE '' END AS ingredients,
    p_partkey % 4 < 2 AS has_full
  FROM part WHERE p_partkey % 10 > 0 AND p_size % 3 < 2
  UNION ALL SELECT p_partkey, p_brand, p_size, 'own', '', CAST(p_size AS DOUBLE), '', FALSE FROM part WHERE p_size % 3 < 2)"""


@query(f"""
WITH {_LD_ITEMS}
SELECT p_partkey, dish_name, description, price, ingredients, has_full,
  CASE WHEN p_size % 3 = 0 THEN 'Shop ' || p_brand ELSE '' END AS restaurant,
  CASE WHEN p_size % 3 = 0 THEN 'Astoria, NY' ELSE ', ' END AS place FROM ld
""")
def jsonld_items(spark: SparkSession, sf: str) -> DataFrame:
    found = with_jsonld(spread_small(_menu_pages(spark, sf))).select("p_partkey", "meta", F.explode("items").alias("i"))
    return found.select(
        "p_partkey", "i.dish_name", "i.description", F.round("i.price", 2).alias("price"),
        F.array_join("i.stated_ingredients", ",").alias("ingredients"),
        F.col("i.has_full_ingredients").alias("has_full"),
        F.col("meta.restaurant_name").alias("restaurant"),
        F.concat("meta.city", F.lit(", "), "meta.state").alias("place"),
    )


@query("""
SELECT count(*) FILTER (WHERE p_size % 3 < 2) AS hits, count(*) AS pages,
  round(count(*) FILTER (WHERE p_size % 3 < 2)::DOUBLE / count(*), 6) AS rate FROM part
""")
def jsonld_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return P.hit_rate(with_jsonld(spread_small(_menu_pages(spark, sf)))).withColumn("rate", F.round("rate", 6))


# ---------------------------------------------------------------- signals

_SEEDED = (
    "html || CASE page_id % 6 WHEN 0 THEN '<p>Our MENU $1.00 $ 2 and $3.50</p>' WHEN 1 THEN '<p>$1 $2 $3</p>' "
    "WHEN 2 THEN '<div itemtype=\"https://schema.org/MenuItem\">' WHEN 3 THEN '<p>menu $1 $2</p>' "
    "WHEN 4 THEN '{\"@type\": \"MenuSection\"}' ELSE '' END"
)
_STATUS = "CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 WHEN 2 THEN 410 WHEN 3 THEN NULL ELSE 200 END"
_SIGNAL = f"""
seen AS (
  SELECT page_id, url, {_STATUS} AS status, CASE WHEN page_id % 5 = 0 THEN url || '/' ELSE 'https://x.com' END AS primary_url,
         lower({_SEEDED}) AS l FROM pages),
signals AS (
  SELECT *, contains(l, '"menu"') OR contains(l, '"menuitem"') OR contains(l, '"menusection"') OR contains(l, 'schema.org/menu')
    OR (len(regexp_extract_all(l, '\\$\\s?\\d+(?:\\.\\d{{2}})?')) >= 3
        AND regexp_matches(l, 'menu|appetizer|entree|entrée|dessert|dishes|lunch|dinner')) AS signal FROM seen)"""


def _seen_pages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").selectExpr(
        "page_id", "url", f"{_STATUS} AS status",
        "CASE WHEN page_id % 5 = 0 THEN url || '/' ELSE 'https://x.com' END AS primary_url", f"{_SEEDED} AS html",
    )


@query(f"WITH {_SIGNAL} SELECT page_id, signal FROM signals")
def menu_signal(spark: SparkSession, sf: str) -> DataFrame:
    pages = with_jsonld(_seen_pages(spark, sf))
    return pages.select("page_id", D.menu_signal("html", F.col("jsonld_hit")).alias("signal"))


@query(f"""
WITH {_SIGNAL}
SELECT page_id, CASE WHEN status IS NULL THEN 'keep: fetch failed' WHEN status IN (404, 410) THEN 'drop: gone'
  WHEN page_id % 5 = 0 AND regexp_replace(url, '/$', '') = regexp_replace(primary_url, '/$', '') THEN 'keep: primary site'
  WHEN status <> 200 THEN 'keep: blocked'
  WHEN signal THEN 'keep: menu signal' ELSE 'drop: no signal' END AS decision
FROM signals
""")
def keep_drop(spark: SparkSession, sf: str) -> DataFrame:
    return D.check_pages(_seen_pages(spark, sf)).select("page_id", "decision")


@query(f"""
WITH {_SIGNAL} SELECT page_id FROM signals WHERE status IN (404, 410) OR (status = 200 AND NOT signal AND page_id % 5 > 0)
  OR (status = 200 AND NOT signal AND page_id % 5 = 0 AND regexp_replace(url, '/$', '') <> regexp_replace(primary_url, '/$', ''))
""")
def dropped_urls(spark: SparkSession, sf: str) -> DataFrame:
    pages = _seen_pages(spark, sf)
    kept = D.check_pages(pages).filter("keep")
    return D.dropped_urls(pages.select("page_id"), kept, ["page_id"])


@query(f"""
WITH l AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
         generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages WHERE html LIKE '%<a href="%'),
r AS (
  SELECT page_id, pos, regexp_extract(url, '^[a-z]+://[^/?#]*') || '/menu/' || replace(url_encode(href[2:]), '%2C', ',') AS link FROM l
  WHERE href LIKE '/%' AND href <> '/')
SELECT page_id, link, min(pos) - 1 AS pos FROM r GROUP BY 1, 2
""")
def sub_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn(
        "html", F.regexp_replace("html", '<a href="/', '<a href="/menu/')
    )
    links = D.sub_links(P.with_page(pages), "page_id")
    return links.select("page_id", "link", F.col("pos").cast("bigint").alias("pos"))


@query("""
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://www.toasttab.com/r/' || page_id || '?a=1&b=2'
  ELSE 'https://shop' || page_id || '.popmenu.com/menu' END AS link,
  CAST(len(regexp_extract_all(html, 'href=["'']?(https?://[^"''\\s>]+)', 1)) AS INTEGER) AS pos
FROM pages WHERE page_id % 3 < 2
""")
def ordering_links(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.expr(
        "CASE page_id % 3 WHEN 0 THEN '<a href=\"https://www.toasttab.com/r/' || page_id || '?a=1&amp;b=2\">x</a>"
        "<a href=https://www.toasttab.com/r/' || page_id || '?a=1&b=2>x</a>' "
        "WHEN 1 THEN '<a href=''https://shop' || page_id || '.popmenu.com/menu''>y</a>' ELSE '<a href=\"https://eat.com\">n</a>' END"
    )
    pages = table(spark, sf, "pages").select("page_id", F.concat("html", extra).alias("html"))
    return links_in(pages, "page_id", "html").select("page_id", "link", "pos")


# ---------------------------------------------------------------- images

@query("""
WITH t AS (
  SELECT p_partkey, p_size, CASE p_partkey % 8 WHEN 0 THEN '/img/menu-' WHEN 1 THEN '/img/logo-menu-' WHEN 2 THEN '/img/food-'
      WHEN 3 THEN '/img/photo-' WHEN 4 THEN '/img/hero-' WHEN 5 THEN '/drink-' WHEN 6 THEN '/x/pic-' ELSE '' END AS base,
    CASE WHEN p_partkey % 8 = 6 AND p_size % 4 = 0 THEN '.svg' ELSE '.png' END AS ext,
    p_size * 20 AS width, CASE WHEN p_size % 3 = 0 THEN 900 ELSE 0 END AS height,
    CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Our Menu' ELSE 'photo' END AS alt, p_size % 2 = 0 AS in_menu
  FROM part WHERE p_partkey % 8 <> 7),
s AS (
  SELECT *, CASE WHEN ext = '.svg' OR width < 100 THEN 0 ELSE
    CASE WHEN alt = '' THEN 1 WHEN lower(alt) LIKE '%menu%' THEN 2 ELSE 0 END
    + CASE WHEN width >= 800 OR height >= 800 THEN 3 ELSE 0 END
    + CASE WHEN regexp_matches(base, 'menu|food|drink') THEN 3 ELSE 0 END
    - CASE WHEN regexp_matches(base, 'logo|hero') THEN 6 ELSE 0 END + CASE WHEN in_menu THEN 2 ELSE 0 END END AS score
  FROM t)
SELECT p_partkey, 'http://e.com' || base || p_partkey || ext AS image_url, CAST(score AS INTEGER) AS score,
       CAST(width * height AS BIGINT) AS area, 1 AS rank
FROM s WHERE score >= 4
""")
def image_candidates(spark: SparkSession, sf: str) -> DataFrame:
    base = F.expr(
        "CASE p_partkey % 8 WHEN 0 THEN '/img/menu-' WHEN 1 THEN '/img/logo-menu-' WHEN 2 THEN '/img/food-' "
        "WHEN 3 THEN '/img/photo-' WHEN 4 THEN '/img/hero-' WHEN 5 THEN '/drink-' WHEN 6 THEN '/x/pic-' END"
    )
    ext = F.when((F.col("p_partkey") % 8 == 6) & (F.col("p_size") % 4 == 0), ".svg").otherwise(".png")
    source = F.concat(base, F.col("p_partkey").cast("string"), ext)
    width = (F.col("p_size") * 20).cast("string")
    size = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("srcset='a.png 2x, b.png "), width, F.lit("w'"))).otherwise(
        F.concat(F.lit("width="), width)
    )
    alt = F.expr("CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Our Menu' ELSE 'photo' END")
    image = F.concat(
        F.lit("<img "), F.when(F.col("p_size") % 7 == 0, "data-src").otherwise("src"), F.lit("='"), source,
        F.lit("' "), size, F.when(F.col("p_size") % 3 == 0, " height=900").otherwise(""), F.lit(" alt='"), alt, F.lit("'>"),
    )
    html = F.concat(
        F.lit("<header><img src='/menu.png' width=900></header><div id='"),
        F.when(F.col("p_size") % 2 == 0, "Main-MENU").otherwise("main"), F.lit("'><p>x"),
        F.coalesce(image, F.lit("<img alt='menu' width=900>")), F.lit("</div>"),
    )
    pages = table(spark, sf, "part").select("p_partkey", F.lit("http://e.com/a/").alias("url"), html.alias("html"))
    return P.menu_images(P.with_page(pages), "p_partkey")


# ---------------------------------------------------------------- platforms, classes, routes

_BUILT = (
    "html || CASE page_id % 6 WHEN 0 THEN '<script src=\"https://static.wixstatic.com/a.js\">' WHEN 1 THEN '/WP-content/x' "
    "WHEN 2 THEN 'toasttab squarespace' WHEN 3 THEN '_next/static/chunk' ELSE '' END"
)


@query("""
WITH p AS (SELECT CASE page_id % 6 WHEN 0 THEN 'Wix' WHEN 1 THEN 'WordPress' WHEN 2 THEN 'Squarespace' WHEN 3 THEN 'Next.js'
  ELSE 'other/unknown' END AS platform FROM pages)
SELECT platform, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM p GROUP BY 1
""")
def platform_hist(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(P.platform(F.expr(_BUILT)).alias("platform"))
    return P.histogram(pages, "platform").withColumn("pct", F.round("pct", 6))


_CLASSED = """
classed AS (
  SELECT CASE WHEN l_linenumber = 1 THEN 'no-site' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'no-menu'
      WHEN l_quantity > 40 THEN 'js-text-deeplink' WHEN l_quantity < 5 THEN 'image-menu'
      WHEN l_linestatus = 'O' AND l_discount > 0.05 THEN 'js-text-deeplink' ELSE 'interaction-required' END AS class,
    CAST(l_linenumber AS INTEGER) AS img_candidates, l_quantity >= 5 AND l_linenumber > 5 AS img_guard_fired FROM lineitem)"""


def _classed(spark: SparkSession, sf: str) -> DataFrame:
    kind = P.page_class(
        n_urls=F.col("l_linenumber") - 1,
        fetched=~((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")),
        text_items=F.greatest(F.col("l_quantity") - 40, F.lit(0)),
        image_items=F.greatest(5 - F.col("l_quantity"), F.lit(0)),
        rendered=F.col("l_linestatus") == "O",
        script_items=F.when(F.col("l_discount") > 0.05, 1).otherwise(0),
    )
    return table(spark, sf, "lineitem").select(
        kind.alias("class"), F.col("l_linenumber").alias("img_candidates"),
        ((F.col("l_quantity") >= 5) & (F.col("l_linenumber") > 5)).alias("img_guard_fired"),
    )


@query(f"""
WITH {_CLASSED}, known AS (SELECT unnest(['no-site', 'no-menu', 'image-menu', 'js-text-deeplink', 'interaction-required', 'delivery-only']) AS class)
SELECT k.class, count(c.class) AS n, round(100.0 * count(c.class) / (SELECT count(*) FROM classed), 6)::DOUBLE AS pct
FROM known k LEFT JOIN classed c ON c.class = k.class GROUP BY 1
""")
def page_class_hist(spark: SparkSession, sf: str) -> DataFrame:
    return P.histogram(_classed(spark, sf), "class", PAGE_CLASSES).withColumn("pct", F.round("pct", 6))


@query(f"""
WITH {_CLASSED}
SELECT count(*) AS total, CAST(sum(img_candidates) AS BIGINT) AS candidates, count(*) FILTER (WHERE img_guard_fired) AS guard_fired,
  count(*) FILTER (WHERE class = 'image-menu') AS image_menus,
  round(100.0 * count(*) FILTER (WHERE class = 'interaction-required') / count(*), 6)::DOUBLE AS interaction_pct,
  100.0 * count(*) FILTER (WHERE class = 'interaction-required') / count(*) > 15 AS go FROM classed
""")
def coverage_summary(spark: SparkSession, sf: str) -> DataFrame:
    return P.coverage_summary(_classed(spark, sf)).withColumn("interaction_pct", F.round("interaction_pct", 6))


@query()
def tier_route(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").withColumn(
        "content_type", F.when(F.col("url").contains(".pdf"), "application/pdf").otherwise("text/html")
    )
    routed = P.route_pages(pages)
    return routed.select("page_id", "route", "noisy", "script_shell", "runes", "menu_image", "jsonld_hit")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'pdf' WHEN p_partkey % 7 = 1 THEN 'jsonld' WHEN p_partkey % 7 = 2 THEN 'webagent'
  WHEN p_partkey % 7 = 3 THEN 'image_ocr' WHEN p_partkey % 7 = 4 THEN 'refuse' ELSE 'html_llm' END AS route FROM part
""")
def tier_route_parts(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("p_partkey") % 7
    long_text = F.repeat(F.concat(F.lit("<p>a long enough line about "), "p_name", F.lit("</p>")), 12)
    html = (
        F.when(case == 1, F.concat(F.lit('<script type="application/ld+json">{"@type":"MenuItem","name":"'), "p_name", F.lit('"}</script>x')))
        .when(case == 2, F.concat(F.lit("<div>"), "p_name", F.lit("</div><script src=a.js></script>")))
        .when(case == 3, F.concat(F.lit("<p>"), "p_name", F.lit("</p><div id=menu><img src=/menu.png></div>")))
        .when(case == 4, F.concat(F.lit("<p>"), "p_name", F.lit("</p>")))
        .otherwise(long_text)
    )
    pages = table(spark, sf, "part").select(
        "p_partkey", F.lit("http://e.com/").alias("url"), html.alias("html"),
        F.when(case == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"),
    )
    return P.route_pages(pages).select("p_partkey", "route")


# ---------------------------------------------------------------- discovery

_ANSWER = (
    "CASE o_custkey % 4 WHEN 0 THEN '```json{\"website_url\": \"https://r' || o_custkey || '.com/\", \"menu_urls\": [\"https://r' || o_custkey || "
    "'.com/menu\", \"https://menupages.com/' || o_custkey || '\", \"https://www.yelp.com/' || o_custkey || '\"], \"address\": \"A' || o_custkey || '\"}```' "
    "WHEN 1 THEN ' {\"website_url\": \"\", \"menu_urls\": [\"https://doordash.com/' || o_custkey || '\"]} ' "
    "WHEN 2 THEN 'See https://a.com/x (and https://b.com/y) for ' || o_orderkey ELSE '{\"menu_urls\": null, \"website_url\": \"https://www.yelp.com/biz\"}' END"
)
_CANDIDATES = """
cand AS (
  SELECT o_orderkey AS camis, o_custkey % 4 AS k, o_custkey AS c, unnest(CASE o_custkey % 4
      WHEN 0 THEN ['https://r' || o_custkey || '.com/', 'https://r' || o_custkey || '.com/menu',
                   'https://r' || o_custkey || '.com/menus', 'https://www.yelp.com/' || o_custkey]
      WHEN 1 THEN ['https://doordash.com/' || o_custkey]
      WHEN 2 THEN ['https://a.com/x', 'https://b.com/y']
      ELSE ['https://www.yelp.com/biz', 'https://www.yelp.com/biz/menu', 'https://www.yelp.com/biz/menus'] END) AS url,
    unnest(CASE o_custkey % 4 WHEN 0 THEN [0, 1, 3, 6] WHEN 1 THEN [0] WHEN 2 THEN [0, 1] ELSE [0, 1, 3] END) AS pos
  FROM orders)"""


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    events = spread_small(table(spark, sf, "orders")).select(
        F.col("o_orderkey").alias("camis"), F.expr(_ANSWER).alias("response_text")
    )
    return D.parse_answers(events)


@query(f"WITH {_CANDIDATES} SELECT camis, url, CAST(pos AS INTEGER) AS pos FROM cand")
def discovery_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return D.candidate_urls(_answers(spark, sf))


_SELECTION = """
SELECT o_orderkey AS camis,
  CASE o_custkey % 4 WHEN 0 THEN 'https://r' || o_custkey || '.com/' WHEN 1 THEN 'https://doordash.com/' || o_custkey
    WHEN 2 THEN 'https://a.com/x' ELSE 'https://www.yelp.com/biz' END AS website_url,
  CASE o_custkey % 4 WHEN 0 THEN 'https://r' || o_custkey || '.com/,https://r' || o_custkey || '.com/menu,https://r' || o_custkey || '.com/menus'
    WHEN 1 THEN 'https://doordash.com/' || o_custkey WHEN 2 THEN 'https://a.com/x,https://b.com/y'
    ELSE 'https://www.yelp.com/biz,https://www.yelp.com/biz/menu,https://www.yelp.com/biz/menus' END AS menu_urls,
  CASE WHEN o_custkey % 4 IN (1, 3) THEN 'gemini_delivery' ELSE 'gemini' END AS url_source
FROM orders
"""


@query(_SELECTION)
def discovery_selection(spark: SparkSession, sf: str) -> DataFrame:
    chosen = D.select_answer_urls(_answers(spark, sf))
    return chosen.withColumn("menu_urls", F.array_join("menu_urls", ","))


@query(_SELECTION)
def discovery_confirmed(spark: SparkSession, sf: str) -> DataFrame:
    """The same choice from confirmed rows, as after a page check."""
    answered = _answers(spark, sf)
    sites = answered.select("camis", F.coalesce("answer.website_url", F.lit("")).alias("website_url"))
    chosen = D.select_urls(D.candidate_urls(answered), sites)
    return chosen.withColumn("menu_urls", F.array_join("menu_urls", ","))


_SUBS = {
    "url": "l_orderkey", "pos": "l_linenumber * 1000000 + l_partkey * 100 + l_suppkey",
    "restaurant_name": "CASE WHEN l_partkey % 3 = 0 THEN 'P' || l_partkey ELSE '' END",
    "city": "CASE WHEN l_suppkey % 3 = 0 THEN 'C' || l_suppkey ELSE '' END",
    "state": "CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey ELSE '' END",
    "address": "CASE WHEN l_partkey % 4 = 0 THEN 'A' || l_partkey ELSE '' END",
    "phone_number": "''",
}


@query("""
WITH s AS (
  SELECT l_orderkey AS url, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey AS pos,
    CASE WHEN l_partkey % 3 = 0 THEN 'P' || l_partkey ELSE '' END AS rn, CASE WHEN l_suppkey % 3 = 0 THEN 'C' || l_suppkey ELSE '' END AS city,
    CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey ELSE '' END AS state,
    CASE WHEN l_partkey % 4 = 0 THEN 'A' || l_partkey ELSE '' END AS address, l_linenumber AS items FROM lineitem),
f AS (
  SELECT url, arg_min(rn, pos) FILTER (WHERE rn <> '') AS rn, arg_min(city, pos) FILTER (WHERE city <> '') AS city,
    arg_min(state, pos) FILTER (WHERE city <> '') AS state, arg_min(address, pos) FILTER (WHERE address <> '') AS address,
    CAST(sum(items) AS BIGINT) AS item_count FROM s GROUP BY 1)
SELECT o_orderkey AS url, CASE WHEN o_custkey % 2 = 0 THEN 'Root' ELSE COALESCE(rn, '') END AS restaurant_name,
  CASE WHEN o_custkey % 3 = 0 THEN 'RootCity' ELSE COALESCE(city, '') END AS city,
  CASE WHEN o_custkey % 3 = 0 OR city IS NULL THEN 'RS' ELSE state END AS state, COALESCE(address, '') AS address, item_count
FROM orders JOIN f ON f.url = o_orderkey
""")
def directory_merge(spark: SparkSession, sf: str) -> DataFrame:
    subs = table(spark, sf, "lineitem").selectExpr(
        *[f"{e} AS {n}" for n, e in _SUBS.items()], "array_repeat(named_struct('dish_name', 'd'), l_linenumber) AS items"
    )
    roots = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS url", "CASE WHEN o_custkey % 2 = 0 THEN 'Root' ELSE '' END AS restaurant_name",
        "CASE WHEN o_custkey % 3 = 0 THEN 'RootCity' ELSE '' END AS city", "'RS' AS state", "'' AS address", "'' AS phone_number",
    )
    return D.merge_directory(roots, subs).drop("phone_number", "extraction_tier")


@query("""
SELECT l_orderkey AS url, CAST(sum(l_linenumber) AS BIGINT) AS items FROM lineitem GROUP BY 1
""")
def directory_items(spark: SparkSession, sf: str) -> DataFrame:
    subs = table(spark, sf, "lineitem").selectExpr(
        *[f"{e} AS {n}" for n, e in _SUBS.items()], "array_repeat(named_struct('dish_name', 'd'), l_linenumber) AS items"
    )
    return D.directory_items(subs).groupBy("url").agg(F.count(F.lit(1)).alias("items"))
