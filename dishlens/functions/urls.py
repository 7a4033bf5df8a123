"""URL features as column expressions (patterns that Java reads; no per-row Python)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F

from dishlens import constants as K
from dishlens.functions.text import alternation

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?"
_HOST = _AUTHORITY + r"(\[[^\]]*\]|[^/?#:]*)"
_HOST_PORT = _AUTHORITY + r"([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_OCTET = r"(0|[1-9]\d{0,2})"
_HREF = r"""href=["']?(https?://[^"'\s>]+)"""


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def scheme(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(_col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def host(url: Column | str) -> Column:
    """Host name without port, in lower case; '' where there is none."""
    return F.lower(F.regexp_extract(_col(url), _HOST, 1))


def host_port(url: Column | str) -> Column:
    return F.regexp_extract(_col(url), _HOST_PORT, 1)


def path(url: Column | str) -> Column:
    """Percent-decoded path; NULL when an escape is malformed."""
    raw = F.regexp_extract(_col(url), _PATH, 1)
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(raw, F.lit("%")), decoded).otherwise(raw)


def menu_section(url: Column | str) -> Column:
    """Section name from the last path part: dashes become blanks."""
    parts = F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/")
    return F.coalesce(F.replace(F.element_at(parts, -1), F.lit("-"), F.lit(" ")), F.lit(""))


def _host_or_below(url: Column | str, names: list[str]) -> Column:
    return host(url).rlike(rf"(^|\.)(?:{alternation(names)})$")


def is_blocked(url: Column | str) -> Column:
    return _host_or_below(url, K.BLOCKED_HOSTS)


def is_ordering(url: Column | str) -> Column:
    return _host_or_below(url, K.ORDERING_HOSTS)


def is_delivery(url: Column | str) -> Column:
    """Delivery or review site: the mark may stand anywhere in the url."""
    return F.lower(_col(url)).rlike(alternation(K.DELIVERY_MARKS))


def is_private_host(name: Column | str) -> Column:
    """Loopback, private, link-local and unique-local addresses, and `localhost`."""
    name = F.regexp_replace(_col(name), r"^\[|\]$", "")
    four = F.regexp_replace(F.lower(name), r"^::ffff:(?=\d+\.)", "")
    quad = F.regexp_extract_all(four, F.lit(rf"(?:^|\.){_OCTET}(?=\.|$)"), F.lit(1))
    is_quad = four.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") & F.forall(
        quad, lambda o: o.cast("int") <= 255
    )
    first, second = F.get(quad, F.lit(0)).cast("int"), F.get(quad, F.lit(1)).cast("int")
    private_four = (
        first.isin(10, 127)
        | ((first == 172) & second.between(16, 31))
        | ((first == 192) & (second == 168))
        | ((first == 169) & (second == 254))
    )
    six = F.lower(name)
    private_six = six.rlike(r"^f[cd][0-9a-f]{2}:[0-9a-f:.]*$") | six.rlike(r"^(0{0,4}:)+:?0{0,3}1$")
    return (
        F.when(name == "localhost", True)
        .when(is_quad, private_four)
        .otherwise(private_six)
    )


def api_url_error(url: Column | str, original_host: Column | str) -> Column:
    """Why an inferred endpoint must not be followed; NULL when it is fine."""
    return (
        F.when(~scheme(url).isin("http", "https"), F.lit("scheme"))
        .when(host_port(url) != _col(original_host), F.lit("other host"))
        .when(is_private_host(F.regexp_replace(host_port(url), r":\d+$", "")), F.lit("private host"))
    )


def registrable_domain(name: Column | str) -> Column:
    """Last two labels of a host, after scheme, port and a leading `www.` are dropped."""
    bare = F.regexp_replace(F.lower(_col(name)), r"^.*?://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r":[^:]*$", ""), r"^www\.", "")
    return F.regexp_extract(bare, r"([^.]*\.[^.]*|^[^.]*)$", 1)


def normalise(url: Column | str) -> Column:
    """Scheme and host in lower case, no trailing slash, query or fragment."""
    url = _col(url)
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    return F.concat(head, F.regexp_replace(F.regexp_extract(url, _PATH, 1), "/+$", ""))


def canonical(url: Column | str) -> Column:
    """Comparison key of the url lists: trimmed, one trailing slash dropped."""
    return F.regexp_replace(F.trim(_col(url)), "/$", "")


def has_menu_word(url_path: Column, href: Column) -> Column:
    return F.lower(F.concat_ws(" ", url_path, href)).rlike(alternation(K.MENU_PATH_WORDS))


def _unescape():
    import html

    @F.pandas_udf("string")
    def unescape(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else html.unescape(v))

    return unescape


def ordering_links(df, id_col: str, html_col: str):
    """(id, pos, link) of the ordering-platform links in page markup, first sight of each kept.

    Links are screened in the JVM before the entity decoder (Python) sees them: only a host that
    matches, or one written with an entity, can match after decoding.
    """
    links = F.regexp_extract_all(_col(html_col), F.lit(_HREF), F.lit(1))
    found = df.select(id_col, F.posexplode(links).alias("pos", "raw")).filter(
        is_ordering("raw") | F.col("raw").rlike(r"^https?://[^/?#]*&")
    )
    decoded = found.withColumn("link", _unescape()(F.col("raw"))).filter(is_ordering("link"))
    return decoded.groupBy(id_col, "link").agg(F.min("pos").alias("pos"))
