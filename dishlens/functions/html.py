"""Page parsing. One Python pass per page yields text, anchors and images; the rest is columns.

`html.parser` reports tags as they stand, so the few implied ends that change the text (paragraphs,
list items, table rows, the document head) are supplied here. Against a full HTML5 tree builder the
output can differ in blank lines around badly nested markup.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, functions as F

from dishlens import constants as K
from dishlens.functions.text import alternation

PAGE_STRUCT = (
    "struct<markdown: string, "
    "anchors: array<struct<pos: int, href: string, url: string>>, "
    "images: array<struct<pos: int, src: string, url: string, srcset: string, width: string, "
    "height: string, alt: string, in_menu: boolean>>>"
)
_STRINGS = {name: pa.string() for name in ("src", "url", "srcset", "width", "height", "alt")}
PAGE_TYPE = pa.struct({
    "markdown": pa.string(),
    "anchors": pa.list_(pa.struct({"pos": pa.int32(), "href": pa.string(), "url": pa.string()})),
    "images": pa.list_(pa.struct({"pos": pa.int32(), **_STRINGS, "in_menu": pa.bool_()})),
})
#: Characters of pages whose rows are Python objects at once; those take many times the bytes of Arrow's columns.
HELD = 256 << 10

_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table "
    "ul li".split()
)
_HEAD_ONLY = frozenset("title base link meta style script noscript template".split())
_SKIPPED = frozenset(K.SKIPPED_TAGS)
_OPENING = {
    "h1": "\n# ", "h2": "\n## ", "h3": "\n### ", "h4": "\n#### ", "h5": "\n#### ", "h6": "\n#### ",
    "li": "\n- ", "button": "\n- ",
    "p": "\n", "div": "\n", "section": "\n", "article": "\n", "tr": "\n",
}
_CLOSING = frozenset("h1 h2 h3 h4 h5 h6 li button p tr".split())
_CHROME = frozenset(("header", "footer", "nav"))


def resolve(base: str, href: str) -> str | None:
    """Absolute url without fragment; characters a path may not hold are percent-encoded."""
    try:
        parts = urlsplit(urljoin(base, href.strip()))
        clean = quote(parts.path, safe="%/!$&'()*+,;=:@[]~-._")
        return urlunsplit((parts.scheme, parts.netloc, clean, parts.query, ""))
    except ValueError:
        return None


class _Page(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.out: list[str] = []
        self.anchors: list[dict] = []
        self.images: list[dict] = []
        self.open: list[tuple[str, bool]] = []  # (tag, carries a menu id)
        self.counts: Counter[str] = Counter()  # open elements by tag
        self.skipping = 0
        self.chrome = 0
        self.menus = 0
        self.in_body = False

    def _enter(self, tag: str, menu: bool) -> None:
        self.open.append((tag, menu))
        self.counts[tag] += 1
        self.menus += menu
        self.skipping += tag in _SKIPPED
        self.chrome += tag in _CHROME

    def _leave(self) -> None:
        tag, menu = self.open.pop()
        self.counts[tag] -= 1
        self.menus -= menu
        self.skipping -= tag in _SKIPPED
        self.chrome -= tag in _CHROME
        if tag in _CLOSING and not self.skipping:
            self.out.append("\n")

    def _close(self, tag: str, barriers: frozenset[str] = frozenset()) -> None:
        """Leave elements up to the innermost `tag`, unless a barrier stands in between."""
        if not self.counts[tag]:
            return
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth][0]
            if name == tag:
                while len(self.open) > depth:
                    self._leave()
                return
            if name in barriers:
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("html", "head", "body"):
            if tag == "head" and not self.in_body:
                self._enter("head", False)
            elif tag == "body":
                self._begin_body()
            self.menus += any(n == "id" and "menu" in (v or "").lower() for n, v in attrs)
            return
        if not self.in_body and tag not in _HEAD_ONLY:
            self._begin_body()
        if tag in _CLOSES_PARAGRAPH:
            self._close("p", frozenset(("button", "table", "td", "th", "object")))
        if tag == "li":
            self._close("li", frozenset(("ul", "ol", "menu", "dir")))
        elif tag == "tr":
            self._close("tr", frozenset(("table",)))
        elif tag in ("td", "th"):
            self._close("td", frozenset(("table", "tr")))
            self._close("th", frozenset(("table", "tr")))
        elif tag == "button":
            self._close("button")
        values = {name: value or "" for name, value in reversed(attrs)}
        menu = "menu" in values.get("id", "").lower()
        if tag == "a" and values.get("href"):
            self.anchors.append({
                "pos": len(self.anchors),
                "href": values["href"],
                "url": resolve(self.base, values["href"]),
            })
        elif tag == "img" and not self.chrome:
            self._image(values, menu)
        if not self.skipping and (self.in_body or tag not in _HEAD_ONLY):
            self.out.append(_OPENING.get(tag, ""))
        if tag not in _VOID:
            self._enter(tag, menu)

    def handle_startendtag(self, tag, attrs):
        # A slash closes nothing in HTML: only void elements end at once.
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag == "head":
            self._close("head")
        elif tag == "p" and not self.counts["p"]:
            if self.in_body and not self.skipping:
                self.out.append("\n\n")
        elif tag not in ("html", "body"):
            self._close(tag)

    def handle_data(self, data):
        text = data.strip(K.WHITE_SPACE)
        if not text:
            return
        inside = self.open[-1][0] if self.open else ""
        if not self.in_body and inside not in _HEAD_ONLY:
            self._begin_body()
        if not self.skipping and self.in_body:
            self.out.append(text + " ")

    def _begin_body(self) -> None:
        self._close("head")
        self.in_body = True

    def _image(self, values: dict, menu: bool) -> None:
        source = values.get("src") or values.get("data-src") or ""
        self.images.append({
            "pos": len(self.images),
            "src": source,
            "url": resolve(self.base, source) if source else None,
            "srcset": values.get("srcset"),
            "width": values.get("width"),
            "height": values.get("height"),
            "alt": values.get("alt"),
            "in_menu": bool(self.menus or menu),
        })


def parse_page(html: str, base: str = "") -> dict:
    page = _Page(base or "")
    page.feed(html)
    page.close()
    while page.open:
        page._leave()
    return {"markdown": "".join(page.out), "anchors": page.anchors, "images": page.images}


def parse_pages(pages: pa.Array, bases: pa.Array) -> pa.Array:
    done, rows, held = [], [], 0
    for page, base in zip(pages, bases, strict=True):
        html = page.as_py() or ""
        rows.append(parse_page(html, base.as_py()))
        held += len(html)
        if held >= HELD:
            done.append(pa.array(rows, PAGE_TYPE))
            rows, held = [], 0
    return pa.concat_arrays([*done, pa.array(rows, PAGE_TYPE)])


def parsed(html: Column | str, url: Column | str) -> Column:
    """STRUCT<markdown, anchors, images> of a page, by Arrow batch."""

    @F.arrow_udf(PAGE_STRUCT)
    def parse(pages: pa.Array, bases: pa.Array) -> pa.Array:
        return parse_pages(pages, bases)

    # Declared nondeterministic so that the optimizer never copies it into a second evaluation.
    return parse.asNondeterministic()(
        F.col(html) if isinstance(html, str) else html, F.col(url) if isinstance(url, str) else url
    )


# ---------------------------------------------------------------- image scoring

def srcset_width(srcset: Column) -> Column:
    """Widest `w` descriptor of a srcset, 0 when there is none."""
    widths = F.transform(
        F.split(F.coalesce(srcset, F.lit("")), ","),
        lambda part: F.coalesce(
            F.regexp_extract(F.trim(part), r"^\S.*\s(\d{1,9})w$", 1).try_cast("int"), F.lit(0)
        ),
    )
    return F.greatest(F.array_max(widths), F.lit(0))


def _dimension(value: Column) -> Column:
    return F.coalesce(F.when(value.rlike(r"^[+-]?\d{1,9}$"), value.try_cast("int")), F.lit(0))


def image_width(image: Column) -> Column:
    return F.greatest(srcset_width(image["srcset"]), _dimension(image["width"]), F.lit(0))


def image_height(image: Column) -> Column:
    return F.greatest(_dimension(image["height"]), F.lit(0))


def image_score(image: Column) -> Column:
    """Additive menu-image score of one parsed image; 0 for what can be no menu."""
    width, height = image_width(image), image_height(image)
    source = F.lower(image["src"])

    def points(condition: Column, value: int) -> Column:
        return F.when(condition, F.lit(value)).otherwise(F.lit(0))

    total = (
        points(image["alt"] == "", 1)
        + points(F.lower(image["alt"]).contains("menu"), 2)
        + points((width >= 800) | (height >= 800), 3)
        + points(source.rlike(alternation(K.IMAGE_GOOD_WORDS)), 3)
        - points(source.rlike(alternation(K.IMAGE_BAD_WORDS)), 6)
        + points(image["in_menu"], 2)
    )
    unusable = (
        (source == "") | ((width > 0) & (width < 100)) | source.endswith(".svg")
    )
    return F.when(unusable, F.lit(0)).otherwise(total)
