"""Menu-url discovery over stored model answers and fetched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dishlens import constants as K
from dishlens.functions import urls as U
from dishlens.functions.jsonld import with_jsonld
from dishlens.functions.text import alternation
from dishlens.operators.dedup import distinct_urls
from dishlens.operators.spread import let, spread_small

_URL_IN_TEXT = r"""https?://[^\s)+"']+"""


def clean_answer(text: Column | str) -> Column:
    """Answer without blanks and code fences around it."""
    text = F.col(text) if isinstance(text, str) else text
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^(?:```json)?(?:```)?", ""), r"```$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def parse_answers(events: DataFrame, text: str = "response_text") -> DataFrame:
    """Add `answer` (website_url, menu_urls, address, phone_number; NULL when the text is no such JSON)."""

    def read(value: Column) -> Column:
        def fits(path: str, kind: str) -> Column:
            leaf = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
            return F.coalesce(leaf.rlike(f"^({kind}|VOID)"), F.lit(True))

        def get(path: str) -> Column:
            return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))

        good = (
            F.schema_of_variant(value).rlike("^(OBJECT|VOID)")
            & fits("$.website_url", "STRING") & fits("$.address", "STRING")
            & fits("$.phone_number", "STRING") & fits("$.menu_urls", "ARRAY<(STRING|VOID)>")
        )
        menu_urls = F.try_variant_get(value, "$.menu_urls", "array<string>")
        return F.when(good, F.struct(
            get("$.website_url").alias("website_url"),
            F.coalesce(menu_urls, F.array().cast("array<string>")).alias("menu_urls"),
            get("$.address").alias("address"), get("$.phone_number").alias("phone_number"),
        ))

    return events.withColumn("answer", let(F.try_parse_json(clean_answer(text)), read))


def _urls_of_answer(text: str) -> Column:
    """The site, its usual menu paths and the listed urls; urls found anywhere in the text when it is no JSON."""
    site = F.col("answer.website_url")
    base = F.regexp_replace(site, "/$", "")
    own = F.when(
        site != "",
        F.array(site, F.concat(base, F.lit("/menu")), F.concat(base, F.lit("/menu/")),
                F.concat(base, F.lit("/menus"))),
    ).otherwise(F.array().cast("array<string>"))
    listed = F.concat(own, F.col("answer.menu_urls"))
    return F.when(F.col("answer").isNotNull(), listed).otherwise(
        F.regexp_extract_all(F.col(text), F.lit(_URL_IN_TEXT), F.lit(0))
    )


def candidate_urls(answered: DataFrame, owner: str = "camis", text: str = "response_text") -> DataFrame:
    """(owner, pos, url): the urls of each answer. Repeats and blocked hosts are dropped."""
    rows = answered.select(owner, F.posexplode(_urls_of_answer(text)).alias("pos", "url"))
    # blocked hosts go before the shuffle; spellings of one url have one host
    return distinct_urls(rows.filter(~U.is_blocked(F.trim("url"))), owner, "url", "pos")


def dropped_urls(before: DataFrame, after: DataFrame, on: list[str]) -> DataFrame:
    """What a stage dropped."""
    return before.join(after.select(*on), on, "left_anti")


def menu_signal(html: Column | str, jsonld_hit: Column) -> Column:
    """Evidence of a menu: JSON-LD items, schema.org menu markup, or three prices and a menu word."""
    lower = F.lower(F.col(html) if isinstance(html, str) else html)
    marked = lower.rlike(alternation(K.MENU_MARKUP))
    priced = F.regexp_count(lower, F.lit(K.PRICE_PATTERN)) >= 3
    return jsonld_hit | marked | (priced & lower.rlike(alternation(K.MENU_WORDS)))


def signal_decision(url: Column, status: Column, primary_url: Column, signal: Column) -> Column:
    """keep/drop reason for a fetched candidate. A NULL status is a failed fetch."""
    def bare(value: Column) -> Column:
        return F.regexp_replace(value, "/$", "")

    primary = (F.coalesce(primary_url, F.lit("")) != "") & (bare(url) == bare(primary_url))
    return (
        F.when(U.is_ordering(url), F.lit("keep: ordering platform"))
        .when(U.is_private_host(U.host(url)), F.lit("drop: private host"))
        .when(status.isNull(), F.lit("keep: fetch failed"))
        .when(status.isin(404, 410), F.lit("drop: gone"))
        .when(primary, F.lit("keep: primary site"))
        .when(~status.between(200, 299), F.lit("keep: blocked"))
        .when(signal, F.lit("keep: menu signal"))
        .otherwise(F.lit("drop: no signal"))
    )


def check_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Pages (url, status, primary_url, html) with `decision` and `keep`."""
    checked = with_jsonld(spread_small(pages), html).withColumn(
        "decision",
        signal_decision(F.col("url"), F.col("status"), F.col("primary_url"),
                        menu_signal(html, F.col("jsonld_hit"))),
    )
    return checked.withColumn("keep", F.col("decision").startswith("keep"))


def select_urls(confirmed: DataFrame, sites: DataFrame, owner: str = "camis") -> DataFrame:
    """Final urls per restaurant from confirmed rows (owner, pos, url) and sites (owner, website_url).

    Direct urls if there are any, delivery sites otherwise; the primary url is the website unless
    that is missing or a delivery site. One restaurant's list is short by nature of its answer, and
    only as long as the array it came from.
    """
    delivery = U.is_delivery("url")
    # what remains of an answer, at most as long as its array
    entry = F.struct("pos", "url")
    lists = confirmed.groupBy(owner).agg(
        F.array_sort(F.collect_list(F.when(~delivery, entry))).alias("direct"),
        F.array_sort(F.collect_list(F.when(delivery, entry))).alias("delivery"),
    )
    joined = sites.select(owner, "website_url").join(lists, owner, "left").withColumns({
        "direct": F.transform("direct", lambda e: e["url"]), "delivery": F.transform("delivery", lambda e: e["url"]),
    })
    return _chosen(joined, owner)


def select_answer_urls(answered: DataFrame, owner: str = "camis", text: str = "response_text") -> DataFrame:
    """`select_urls` where nothing was fetched in between: one answer per owner, chosen within its row.

    Answers are arrays, so no row is shuffled.
    """
    def keyed(values: Column) -> Column:
        return F.transform(values, lambda u: F.struct(u.alias("url"), U.canonical(u).alias("key")))

    def firsts(entries: Column) -> Column:
        keys = F.transform(entries, lambda e: e["key"])
        kept = F.filter(entries, lambda e, i: (F.array_position(keys, e["key"]) == i + 1) & ~U.is_blocked(F.trim(e["url"])))
        return F.transform(kept, lambda e: e["url"])

    urls = let(keyed(_urls_of_answer(text)), firsts)
    rows = answered.select(owner, F.coalesce("answer.website_url", F.lit("")).alias("website_url"), urls.alias("_urls"))
    return _chosen(rows.withColumns({
        "direct": F.filter("_urls", lambda u: ~U.is_delivery(u)), "delivery": F.filter("_urls", U.is_delivery),
    }), owner)


def _chosen(lists: DataFrame, owner: str) -> DataFrame:
    """Direct or else delivery urls of rows (owner, website_url, direct, delivery), and the primary url."""
    has_direct = F.coalesce(F.size("direct"), F.lit(0)) > 0
    has_delivery = F.coalesce(F.size("delivery"), F.lit(0)) > 0
    chosen = F.when(has_direct, F.col("direct")).when(has_delivery, F.col("delivery"))
    urls = F.coalesce(chosen, F.array().cast("array<string>"))
    site = F.coalesce(F.col("website_url"), F.lit(""))
    primary = F.when(
        ((site == "") | U.is_delivery(site)) & (F.size(urls) > 0), F.get(urls, F.lit(0))
    ).otherwise(site)
    source = F.when(~has_direct & has_delivery, F.lit("gemini_delivery")).otherwise(F.lit("gemini"))
    return lists.select(
        owner, primary.alias("website_url"), urls.alias("menu_urls"), source.alias("url_source")
    )


def sub_links(parsed: DataFrame, owner: str, url: str = "url") -> DataFrame:
    """(owner, pos, link): links of a page that may lead to menus on the same site.

    Expects `anchors` of the page parser.
    """
    rows = parsed.select(owner, F.col(url).alias("_base"), F.explode("anchors").alias("a")).select(
        owner, "_base", F.col("a.pos").alias("pos"), F.col("a.href").alias("href"),
        F.col("a.url").alias("link"),
    )
    kept = rows.filter(
        U.scheme("link").isin("http", "https")
        & (U.normalise("link") != U.normalise("_base"))
        & (U.registrable_domain(U.host("link")) == U.registrable_domain(U.host("_base")))
        & U.has_menu_word(F.coalesce(U.path("link"), F.lit("")), F.col("href"))
        & ~U.is_blocked("link")
        & ~U.is_delivery("link")
    )
    return distinct_urls(kept, owner, "link", "pos")


def merge_directory(roots: DataFrame, subs: DataFrame, owner: str = "url") -> DataFrame:
    """Restaurant facts of a directory page: its own, else the first sub-page's that has them.

    City and state come from one page together. `subs` holds (owner, pos, restaurant_name, city,
    state, address, phone_number, items).
    """
    def first(name: str, value: Column) -> Column:
        return F.min_by(F.when(F.col(name) != "", value), F.when(F.col(name) != "", F.col("pos"))).alias(f"_{name}")

    found = subs.groupBy(owner).agg(
        first("restaurant_name", F.col("restaurant_name")),
        first("city", F.struct("city", "state")),
        first("address", F.col("address")),
        first("phone_number", F.col("phone_number")),
        F.sum(F.size("items")).alias("item_count"),
    )
    joined = roots.join(found, owner)

    def own(name: str) -> Column:
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.col(f"_{name}"), F.lit("")).alias(name)

    blank_city = F.coalesce(F.col("city"), F.lit("")) == ""
    return joined.filter("item_count > 0").select(
        owner, own("restaurant_name"),
        F.when(blank_city, F.coalesce("_city.city", F.lit(""))).otherwise(F.col("city")).alias("city"),
        F.when(blank_city & F.col("_city").isNotNull(), F.col("_city.state"))
        .otherwise(F.coalesce("state", F.lit(""))).alias("state"),
        own("address"), own("phone_number"), "item_count",
        F.lit(K.TIER_DIRECTORY).alias("extraction_tier"),
    )


def directory_items(subs: DataFrame, owner: str = "url") -> DataFrame:
    """Items of all sub-pages in order: (owner, pos, item_pos, item columns)."""
    return subs.select(owner, "pos", F.posexplode("items").alias("item_pos", "item")).select(
        owner, "pos", "item_pos", "item.*"
    )
