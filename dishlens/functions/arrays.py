"""Array and record-text functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dishlens import constants as K


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def or_empty(values: Column | str) -> Column:
    return F.coalesce(_col(values), empty_strings())


def distinct_non_blank(values: Column | str, space: str = K.WHITE_SPACE) -> Column:
    """Trimmed, non-blank strings, each at its first place; `space` is what is trimmed."""
    trimmed = F.transform(_col(values), lambda v: F.trim(v, F.lit(space)))
    return F.array_distinct(F.filter(trimmed, lambda v: v != ""))


def record_text(record: Column | str) -> Column:
    """One record as `key: value` pairs sorted by key and joined by ` | `."""
    pairs = F.array_sort(F.map_entries(_col(record)))
    return F.array_join(
        F.transform(
            pairs,
            lambda p: F.concat(p["key"], F.lit(": "), F.coalesce(p["value"], F.lit("<nil>"))),
        ),
        " | ",
    )


def records_text(records: Column | str) -> Column:
    """An array of records (maps) as text, records separated by a blank line."""
    return F.array_join(F.transform(_col(records), record_text), "\n\n")


def page_text(text: Column, ocr_text: Column, ocr_layout: Column) -> Column:
    """Text one page adds to its document: text layer, OCR text and its layout block."""
    def filled(value: Column) -> Column:
        return F.coalesce(value, F.lit("")) != ""

    layout = F.when(
        filled(ocr_text) & filled(ocr_layout), F.concat(F.lit("\n\n[layout]\n"), ocr_layout)
    )
    return F.concat(
        F.coalesce(text, F.lit("")), F.coalesce(ocr_text, F.lit("")), F.coalesce(layout, F.lit(""))
    )


def document_text(pages: Column | str) -> Column:
    """Text of a document from its ordered pages (structs text, ocr_text, ocr_layout)."""
    blobs = F.transform(
        _col(pages), lambda p: page_text(p["text"], p["ocr_text"], p["ocr_layout"])
    )
    return F.array_join(blobs, "\n\n--- page break ---\n\n")


def strip_tag_locale(tag: Column) -> Column:
    return F.regexp_replace(tag, "^en:", "")


def ingredient_names(tags: Column | str) -> Column:
    """Clean ingredient names of a product's tag list: no locale, blanks for dashes, distinct."""
    names = F.transform(_col(tags), lambda t: F.replace(strip_tag_locale(t), F.lit("-"), F.lit(" ")))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def star_text(stars: Column | str) -> Column:
    """Rating as stars, with a half when the fraction is .5 or more."""
    stars = _col(stars)
    whole = F.floor(stars).cast("int")
    half = F.when(stars - whole >= 0.5, F.lit("½")).otherwise(F.lit(""))
    return F.concat(F.repeat(F.lit("★"), whole), half)
