"""Stored page files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def page_owner(path: Column) -> Column:
    """Restaurant id of `<id>-<attempt>.html`: the last dash starts the attempt."""
    name = F.regexp_extract(path, r"([^/]*)\.html$", 1)
    return F.regexp_replace(name, r"^(.+)-[^-]*$", "$1")


def one_page_per_restaurant(pages: DataFrame, path_col: str = "path") -> DataFrame:
    """First path of every restaurant. Only paths are compared; contents join back by path."""
    owned = pages.withColumn("restaurant_id", page_owner(F.col(path_col)))
    first = owned.groupBy("restaurant_id").agg(F.min(path_col).alias(path_col))
    return owned.join(first, ["restaurant_id", path_col], "left_semi")


def read_page_files(spark: SparkSession, path: str) -> DataFrame:
    """(restaurant_id, path, html) of a folder of stored pages, one page per restaurant."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.html")
        .load(path)
    )
    chosen = one_page_per_restaurant(files.select("path", "content"))
    html = F.make_valid_utf8(F.col("content").cast("string"))
    return chosen.select("restaurant_id", "path", html.alias("html"))
