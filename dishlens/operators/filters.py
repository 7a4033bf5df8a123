"""Search and listing filters: an empty field is no predicate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class SearchFilter:
    """Search conditions. `match` picks how texts compare:

    `pattern`: category and city contain the text, state equals it, all without case; `%` and `_`
    in the text stay wildcards. `substring`: all three contain it. `exact`: city and state equal
    the text, category contains it, with case.
    """

    category: str = ""
    city: str = ""
    state: str = ""
    business_id: str = ""
    review_ids: Sequence[str] = field(default_factory=tuple)
    match: str = "pattern"
    alpha: float = 0.0

    def for_businesses(self) -> Column:
        return self._places(with_category=True)

    def for_reviews(self) -> Column:
        condition = self._places(with_category=False)
        by_business = bool(self.business_id)
        if by_business:
            condition &= F.col("business_id") == self.business_id
        if self.review_ids and not (by_business and self.match == "exact"):
            condition &= F.col("review_id").isin(list(self.review_ids))
        return condition

    def _places(self, with_category: bool) -> Column:
        condition = F.lit(True)
        if self.category and with_category:
            column = F.col("categories")
            condition &= (
                column.contains(self.category) if self.match == "exact"
                else column.ilike(f"%{self.category}%")
            )
        if self.city:
            column = F.col("city")
            condition &= (
                column == self.city if self.match == "exact" else column.ilike(f"%{self.city}%")
            )
        if self.state:
            column = F.col("state")
            condition &= {
                "exact": column == self.state,
                "substring": column.ilike(f"%{self.state}%"),
                "pattern": column.ilike(self.state),
            }[self.match]
        return condition


def contains_text(value: str, *columns: str) -> Column:
    """Any of the columns contains the text, without case; a blank text passes everything."""
    if not value:
        return F.lit(True)
    condition = F.lit(False)
    for name in columns:
        condition |= F.coalesce(F.col(name).ilike(f"%{value}%"), F.lit(False))
    return condition


def equals(value: str, column: str) -> Column:
    return F.col(column) == value if value else F.lit(True)


def catalog_filter(search: str = "", level: str = "", group: str = "") -> Column:
    """Text in name or notes, level, group membership; each trimmed, blank means off."""
    search, level, group = search.strip(), level.strip(), group.strip()
    condition = contains_text(search, "ingredient", "notes") & equals(level, "level")
    return condition & F.array_contains("groups", group) if group else condition


def in_city(city: str) -> Column:
    return F.lower("city") == city.lower() if city else F.lit(True)


def semi_by_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in an id frame."""
    return df.join(ids.select(key), key, "left_semi")
