"""Rule selectors over JSON content."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from dishlens.operators.spread import let
from dishlens.schemas import STRUCTURED_UPDATE


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def select_json(content: Column | str, selector: Column | str) -> Column:
    """Text a selector picks: '' takes everything, `json:KEY` the JSON of a top-level key.

    Any other selector, an absent key or content that is no JSON object picks nothing ('').
    """
    content, selector = _col(content), _col(selector)
    key = F.substr(selector, F.lit(len("json:") + 1))

    def member(members: Column) -> Column:
        value = F.coalesce(F.to_json(F.try_element_at(members, key)), F.lit("null"))
        return F.when(F.map_contains_key(members, key), value)

    picked = let(
        F.try_variant_get(F.try_parse_json(content), "$", "map<string,variant>"), member
    )
    return (
        F.when(selector == "", content)
        .when(selector.startswith("json:"), F.coalesce(picked, F.lit("")))
        .otherwise(F.lit(""))
    )


def structured_update(picked: Column | str) -> Column:
    """The regulatory update in selected JSON; NULL unless substance and change type are filled."""
    picked = _col(picked)
    fields = [f.strip().split(" ")[0] for f in STRUCTURED_UPDATE.split(",")]

    def complete(parsed: Column) -> Column:
        filled = (F.coalesce(parsed["substance_name"], F.lit("")) != "") & (
            F.coalesce(parsed["change_type"], F.lit("")) != ""
        )
        return F.when(
            filled, F.struct(*[F.coalesce(parsed[f], F.lit("")).alias(f) for f in fields])
        )

    # try_parse_json tells broken text apart; from_json would read it as a row of NULLs.
    valid = F.when(F.try_parse_json(picked).isNotNull(), picked)
    return let(F.from_json(valid, STRUCTURED_UPDATE), complete)
