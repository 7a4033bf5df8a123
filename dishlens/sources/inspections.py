"""Restaurant inspection records: CSV scan, validity rules, latest record per restaurant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dishlens import constants as K, schemas
from dishlens.functions.dates import inspection_time
from dishlens.functions.text import trim_space
from dishlens.operators.dedup import latest_per_key


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Raw inspection rows, all text, plus `row_pos`; columns are found by header name.

    Ragged rows fail the read. Spark skips that check for pruned columns, so pruning is off for this
    scan. Quoted values may hold line breaks, which makes a file one task; where none do,
    `multi_line=False` lets large files be split (a line break within a value then fails the read).
    """
    raw = spark.read.options(
        header=True, inferSchema=False, mode="FAILFAST", enforceSchema=False, columnPruning=False,
        multiLine=multi_line, escape='"', nullValue="\u0000",
    ).csv(path)
    if "camis" not in raw.columns:
        raise ValueError("missing camis column in csv")
    wanted = schemas.INSPECTION_TEXT_COLUMNS + ["latitude", "longitude"]
    columns = [
        F.coalesce(trim_space(F.col(f"`{c}`")), F.lit("")).alias(c) if c in raw.columns
        else F.lit("").alias(c)
        for c in wanted
    ]
    position = F.struct(
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")
    )
    return raw.select(*columns, position.alias("row_pos"))


def coordinate(value: Column | str) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    number = F.when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), value.try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def valid_records(raw: DataFrame) -> DataFrame:
    """Drop rows without key, in borough '0' or without a usable latitude; coordinates as DOUBLE."""
    return raw.withColumns(
        {"latitude": coordinate("latitude"), "longitude": coordinate("longitude")}
    ).filter((F.col("camis") != "") & (F.col("boro") != "0") & (F.col("latitude") != 0))


def latest_records(records: DataFrame, position: str = "row_pos") -> DataFrame:
    """One record per restaurant: the latest inspection, the earliest row among equals."""
    order = [inspection_time("inspection_date").desc_nulls_last(), F.col(position).asc()]
    return latest_per_key(records, ["camis"], order)


def area_condition(area: str) -> Column:
    """Neighbourhood codes of an area, some of them limited to zip codes."""
    if area not in K.AREAS:
        raise ValueError(f"unknown area: {area!r}")
    spec = K.AREAS[area]
    condition = F.col("nta").isin(spec["ntas"])
    for nta, zips in spec["nta_zips"].items():
        condition |= (F.col("nta") == nta) & F.col("zipcode").isin(zips)
    return condition


def area_records(
    records: DataFrame, area: str, since: Column | str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Records of an area, optionally only those changed after `since` (record_date as text).

    `limit` cuts to a page of that many rows in a fixed order; by default all are kept.
    """
    rows = records.filter(area_condition(area))
    if since is not None:
        rows = rows.filter(F.col("record_date") > (F.lit(since) if isinstance(since, str) else since))
    if limit is not None:
        rows = rows.orderBy("camis", "inspection_date", "record_date").limit(limit)
    return rows


def restaurant_rows(records: DataFrame) -> DataFrame:
    """Inspection records as restaurant rows: blanks and zero coordinates become NULL."""
    def text(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    return records.select(
        "camis", "dba",
        *[text(c).alias(c) for c in ("boro", "building", "street", "zipcode", "phone")],
        F.lit(None).cast("string").alias("address"),
        text("cuisine_description").alias("cuisine"),
        F.nullif("latitude", F.lit(0.0)).alias("latitude"),
        F.nullif("longitude", F.lit(0.0)).alias("longitude"),
        text("nta").alias("nta"),
    )
