"""Text functions: tokens, keyword score, chunking, page-text flags, screening, truncation."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from dishlens import constants as K
from dishlens.operators.spread import let

TOKEN = "[a-z0-9]+"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def alternation(words: list[str]) -> str:
    """Regular expression that finds any of the words literally (Java and RE2 read it alike)."""
    return "|".join(re.sub(r"([.\\|*+?^$()\[\]{}/])", r"\\\1", w) for w in words)


def trim_space(value: Column | str) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.trim(_col(value), F.lit(K.WHITE_SPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(""))


def zero_to_null(value: Column | str) -> Column:
    return F.nullif(_col(value), F.lit(0.0))


def name_key(value: Column | str) -> Column:
    return F.lower(trim_space(value))


# ---------------------------------------------------------------- keyword score

def tokens(value: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits; everything else separates."""
    return F.regexp_extract_all(F.lower(_col(value)), F.lit(TOKEN), F.lit(0))


def query_terms(query: str) -> list[str]:
    return re.findall(TOKEN, query.lower())


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda word: word == term)).cast("double")


def bm25(query: str, text_tokens: Column) -> Column:
    """Keyword score with constant term rarity, averaged over query terms (repeats count again)."""
    terms = query_terms(query)
    if not terms:
        return F.lit(0.0)
    wanted = sorted(set(terms))

    def score(length: Column, hits: Column) -> Column:
        damp = K.BM25_K1 * (1 - K.BM25_B) + K.BM25_K1 * K.BM25_B / K.BM25_AVG_LENGTH * length
        total = F.lit(0.0)
        for term in wanted:
            tf = _occurrences(hits, term)
            total += F.lit(float(terms.count(term))) * tf * F.lit(K.BM25_K1 + 1) / (tf + damp)
        return F.when(length > 0, F.lit(math.log(2)) * total / len(terms)).otherwise(F.lit(0.0))

    # Tokens are found once per text; only the few that match are counted per term.
    return let(text_tokens, lambda words: let(
        F.filter(words, lambda word: word.isin(wanted)),
        lambda hits: score(F.size(words).cast("double"), hits),
    ))


def blend(dense: Column, keyword: Column, alpha: float) -> Column:
    """Weighted mix of vector and keyword score; outside (0, 1) the vector score stands alone."""
    if not 0 < alpha < 1:
        return dense
    return F.lit(alpha) * dense + F.lit(1 - alpha) * keyword


# ---------------------------------------------------------------- chunking

def _pack(parts: list[str], joiner: str, limit: int) -> Iterator[str]:
    """Greedily glue neighbouring parts (each keeping its joiner) while they fit in `limit`."""
    last = len(parts) - 1
    held, size = [], 0
    for at, part in enumerate(parts):
        piece = part + joiner if at < last else part
        if size and size + len(piece) > limit:
            yield "".join(held).strip(K.WHITE_SPACE)
            held, size = [], 0
        held.append(piece)
        size += len(piece)
    if size:
        yield "".join(held).strip(K.WHITE_SPACE)


def _divide(text: str, level: int, limit: int, overlap: int) -> list[str]:
    while level < len(K.CHUNK_SEPARATORS) and K.CHUNK_SEPARATORS[level] not in text:
        level += 1
    if level == len(K.CHUNK_SEPARATORS):
        return [text[at:at + limit] for at in range(0, len(text), limit)]
    joiner = K.CHUNK_SEPARATORS[level]
    flat: list[str] = []
    for piece in _pack(text.split(joiner), joiner, limit):
        flat.extend([piece] if len(piece) <= limit else _divide(piece, level + 1, limit, overlap))
    if not overlap:
        return flat
    # Every level repeats the tail of the piece before, so deep pieces can grow past the limit.
    return flat[:1] + [before[-overlap:] + here for before, here in zip(flat, flat[1:])]


def chunk_text(text: str, limit: int, overlap: int) -> list[str]:
    """Chunks of one text, cut at the coarsest boundary that is present."""
    if limit <= 0 or len(text) <= limit:
        return [text]
    return _divide(text, 0, limit, min(max(overlap, 0), limit - 1))


def chunks(value: Column | str, limit: int = K.CHUNK_RUNES, overlap: int = K.CHUNK_OVERLAP) -> Column:
    """Array of chunks per text. Texts that fit stay in the JVM's hands only for transport."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else chunk_text(t, limit, overlap))

    # Declared nondeterministic so that the optimizer never copies it into a second evaluation.
    return cut.asNondeterministic()(_col(value))


# ---------------------------------------------------------------- page-text flags

def is_noisy(markdown: Column | str) -> Column:
    """At least 20 non-blank lines and more than 70 % of them at most 20 characters long."""
    lines = F.filter(
        F.transform(F.split(_col(markdown), "\n"), trim_space), lambda line: line != ""
    )

    def judge(kept: Column) -> Column:
        total = F.size(kept)
        short = F.size(F.filter(kept, lambda line: F.char_length(line) <= 20))
        return (total >= 20) & (short.cast("double") > total.cast("double") * 0.70)

    return let(lines, judge)


def visible_runes(markdown: Column | str) -> Column:
    return F.char_length(trim_space(markdown))


def is_script_shell(markdown: Column | str, html: Column | str) -> Column:
    """Page whose text is injected by scripts: little visible text against the raw size."""
    html = _col(html)
    size = F.octet_length(html)

    def judge(visible: Column) -> Column:
        ratio = F.floor(size / F.greatest(visible, F.lit(1)))
        return (visible < 500) & (
            ((visible < 60) & html.contains("<script")) | ((size >= 50_000) & (ratio > 500))
        )

    return let(visible_runes(markdown), judge)


# ---------------------------------------------------------------- screening, truncation

def screen_message(value: Column | str) -> Column:
    """Reason a message is refused, NULL when it may pass."""
    value = _col(value)
    hit = F.lower(value).rlike(alternation(K.INJECTION_PHRASES))
    return F.when(F.octet_length(value) > K.MAX_MESSAGE_BYTES, F.lit("too long")).when(
        hit, F.lit("disallowed content")
    )


def truncate_runes(value: Column | str, limit: int) -> Column:
    return F.substring(_col(value), 1, limit)


def truncate_bytes(value: Column | str, limit: int) -> Column:
    """First `limit` bytes; a character cut in two becomes the replacement character."""
    head = F.substring(F.encode(_col(value), "UTF-8"), 1, limit)
    return F.make_valid_utf8(head.cast("string"))


def wrap_untrusted(value: Column | str, max_tokens: int) -> Column:
    """Page text for an extractor: cut to the token budget and fenced as untrusted input."""
    return F.concat_ws(
        "\n", F.lit(K.UNTRUSTED_OPEN), truncate_bytes(value, max_tokens * 4), F.lit(K.UNTRUSTED_CLOSE)
    )
