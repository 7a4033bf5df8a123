"""Pages of ordered listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame


def page_bounds(
    page: str | int | None, limit: str | int | None, default: int = 20, cap: int = 100
) -> tuple[int, int]:
    """(offset, limit) of a page request; anything unusable falls back to page 1 or the default."""
    def whole(value, fallback: int) -> int:
        try:
            number = int(str(value).strip()) if value not in (None, "") else fallback
        except ValueError:
            return fallback
        return number if number >= 1 else fallback

    size = min(whole(limit, default), cap)
    return (whole(page, 1) - 1) * size, size


def paginate(df: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows of one page. Order by a total order, or pages may overlap."""
    return df.orderBy(*order).offset(offset).limit(limit)


def limit_records(df: DataFrame, order: Sequence[Column], limit: int = 0, offset: int = 0) -> DataFrame:
    """Import window: skip `offset`, keep `limit` rows; zero means no bound."""
    if offset > 0:
        df = df.orderBy(*order).offset(offset)
        return df.limit(limit) if limit > 0 else df
    return df.orderBy(*order).limit(limit) if limit > 0 else df
