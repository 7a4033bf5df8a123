"""Page analytics: which way a page is extracted, what it runs on, and reports over both."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from dishlens import constants as K
from dishlens.functions import text as X
from dishlens.functions.html import image_height, image_score, image_width, parsed
from dishlens.functions.jsonld import with_jsonld
from dishlens.functions.text import alternation
from dishlens.operators.spread import spread_small


def with_page(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Add `markdown`, `anchors` and `images`."""
    page = spread_small(pages).withColumn("_page", parsed(html, url))
    return page.select(*pages.columns, "_page.*")


def menu_images(parsed_pages: DataFrame, owner: str) -> DataFrame:
    """(owner, rank, image_url, score, area): likely menu images of each page, best first.

    The images of one page are an array in its own row, so they are ranked inside it.
    """
    scored = F.transform(
        "images",
        lambda i: F.struct(
            (-image_score(i)).alias("minus_score"),
            (-(image_width(i).cast("long") * image_height(i))).alias("minus_area"),
            i["pos"].alias("pos"), i["url"].alias("image_url"),
        ),
    )
    good = F.filter(
        scored, lambda s: (s["minus_score"] <= -K.IMAGE_THRESHOLD) & s["image_url"].isNotNull()
    )
    ranked = parsed_pages.select(owner, F.posexplode(F.array_sort(good)).alias("at", "s"))
    return ranked.select(
        owner, (F.col("at") + 1).alias("rank"), "s.image_url",
        (-F.col("s.minus_score")).alias("score"), (-F.col("s.minus_area")).alias("area"),
    )


def has_menu_image(images: Column | str) -> Column:
    images = F.col(images) if isinstance(images, str) else images
    return F.exists(images, lambda i: image_score(i) >= K.IMAGE_THRESHOLD)


def route(
    content_type: str, renderer: bool = True, vision: bool = True, adapter: bool = False
) -> Column:
    """Extraction tier from the page flags, or `refuse` when the text is too short to be trusted."""
    runes = F.col("runes")
    short = runes < K.SHORT_PAGE_RUNES
    weak = F.col("noisy") | short
    pdf = F.coalesce(F.col(content_type), F.lit("")).contains("pdf")
    choice = F.when(pdf, F.lit(K.TIER_PDF)).when(F.col("jsonld_hit"), F.lit(K.TIER_JSONLD))
    if renderer:
        choice = choice.when(F.col("script_shell") & short, F.lit(K.TIER_RENDERED))
    if vision:
        choice = choice.when(weak & F.col("menu_image"), F.lit(K.TIER_IMAGE))
    if adapter:
        choice = choice.when(weak, F.lit(K.TIER_RENDERED))
    return choice.when(runes < K.MIN_EXTRACT_RUNES, F.lit("refuse")).otherwise(F.lit(K.TIER_HTML))


def route_pages(
    pages: DataFrame, html: str = "html", url: str = "url", content_type: str = "content_type",
    renderer: bool = True, vision: bool = True, adapter: bool = False,
) -> DataFrame:
    """Pages with the columns the decision rests on, and the decision."""
    full = with_jsonld(with_page(pages, html, url), html).withColumns({
        "noisy": X.is_noisy("markdown"),
        "script_shell": X.is_script_shell("markdown", html),
        "runes": X.visible_runes("markdown"),
        "menu_image": has_menu_image("images"),
    })
    return full.withColumn("route", route(content_type, renderer, vision, adapter))


def platform(html: Column | str) -> Column:
    """Site builder by the first mark that is present."""
    lower = F.lower(F.col(html) if isinstance(html, str) else html)
    choice: Column | None = None
    for label, marks in K.PLATFORM_MARKS:
        hit = lower.rlike(alternation(marks))
        choice = F.when(hit, F.lit(label)) if choice is None else choice.when(hit, F.lit(label))
    return choice.otherwise(F.lit(K.PLATFORM_OTHER))


def page_class(
    n_urls: Column, fetched: Column, text_items: Column, image_items: Column, rendered: Column,
    script_items: Column,
) -> Column:
    """Coverage class of a restaurant site from what each way of reading it yielded."""
    return (
        F.when(n_urls == 0, F.lit("no-site"))
        .when(~fetched, F.lit("no-menu"))
        .when(text_items > 0, F.lit("js-text-deeplink"))
        .when(image_items > 0, F.lit("image-menu"))
        .when(rendered & (script_items > 0), F.lit("js-text-deeplink"))
        .otherwise(F.lit("interaction-required"))
    )


def histogram(df: DataFrame, column: str, known: Iterable[str] = ()) -> DataFrame:
    """(column, n, pct): counts with percentages of all rows; known values show even at zero."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    known = list(known)
    if known:
        listed = df.sparkSession.createDataFrame([(v,) for v in known], f"{column} string")
        counts = listed.join(counts, column, "full_outer").fillna(0, subset=["n"])
    # The total is one row; a window over all values would bring them into one task.
    total = df.agg(F.count(F.lit(1)).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        column, "n", F.try_divide(F.lit(100.0) * F.col("n"), F.col("_total")).alias("pct")
    )


def coverage_summary(classified: DataFrame) -> DataFrame:
    """Totals behind the go decision: a share above 15 % of sites that need interaction."""
    wanted = F.col("class") == "interaction-required"
    share = F.try_divide(F.lit(100.0) * F.count_if(wanted), F.count(F.lit(1)))
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("img_candidates").alias("candidates"),
        F.count_if("img_guard_fired").alias("guard_fired"),
        F.count_if(F.col("class") == "image-menu").alias("image_menus"),
        share.alias("interaction_pct"),
        (share > 15).alias("go"),
    )


def hit_rate(pages: DataFrame) -> DataFrame:
    """Share of pages with JSON-LD items."""
    hit = F.col("jsonld_hit").cast("int")
    return pages.agg(
        F.sum(hit).alias("hits"), F.count(F.lit(1)).alias("pages"), F.avg(hit).alias("rate")
    )
