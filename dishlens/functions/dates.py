"""Date parsing for inspection records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted forms, tried in order; anything else counts as "no date".
_SLASHED = r"^\d{2}/\d{2}/\d{4}$"
_ZONED = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_MILLIS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$"


def inspection_time(value: Column | str) -> Column:
    """TIMESTAMP from `MM/dd/yyyy`, RFC 3339 or zone-less milliseconds (UTC); NULL otherwise."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(
        F.when(value.rlike(_SLASHED), F.try_to_timestamp(value, F.lit("MM/dd/yyyy"))),
        F.when(value.rlike(_ZONED), F.try_to_timestamp(value)),
        F.when(value.rlike(_MILLIS), F.try_to_timestamp(F.concat(value, F.lit("Z")))),
    )
