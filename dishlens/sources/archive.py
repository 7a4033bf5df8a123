"""Review archives: tar members unpacked once to parts, then read as tables.

A tar cannot be split, so unpacking is one task per archive; the member streams through in blocks
and lands as parts that any number of tasks read afterwards. Archives must lie on a file system the
executors mount.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dishlens import schemas
from dishlens.operators.dedup import latest_per_key
from dishlens.operators.spread import let

LINES_PER_BATCH = 20_000
LINES_PER_FILE = 500_000


def _member_lines(path: str, member: str) -> Iterator[str]:
    """Lines of the first tar entry whose name contains the text; gzip or plain."""
    with tarfile.open(path, mode="r:*") as archive:
        for entry in archive:
            if entry.isfile() and member in entry.name:
                for line in archive.extractfile(entry):
                    yield line.decode("utf-8", "replace").rstrip("\r\n")
                return
    raise FileNotFoundError(f"no entry containing {member!r} in {path}")


def unpack(spark: SparkSession, path: str, member: str, target: str) -> None:
    """Write (archive, line_no, value) of a member as Parquet parts under `target`."""
    files = spark.read.format("binaryFile").load(path).select("path")

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["archive", "line_no", "value"]
        for batch in batches:
            for name in batch["path"]:
                held = []
                opened = unquote(urlsplit(name).path)
                for number, line in enumerate(_member_lines(opened, member)):
                    held.append((name, number, line))
                    if len(held) >= LINES_PER_BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=columns)

    rows = files.mapInPandas(lines, "archive string, line_no long, value string")
    rows.write.mode("overwrite").option("maxRecordsPerFile", LINES_PER_FILE).parquet(target)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) rows of JSON-lines files."""
    return spark.read.text(path)


def _named(name: str):
    return lambda entry: entry["k"] == name.lower()


def decode_json(lines: DataFrame, schema: str, value: str = "value", strict: bool = False) -> DataFrame:
    """Typed rows of JSON lines; field names match without case, a repeated name counts with its last value.

    A member of the wrong type makes a line malformed; absent members become '' or 0. Malformed lines are dropped, or,
    if `strict`, end the job with the line in the message. No session setting matters for the names of a line's object.
    """
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(",")]
    # Read as a map, an object keeps all its entries in their order.
    entries = F.map_entries(F.from_json(value, "map<string,variant>"))
    folded = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("k"), e["value"].alias("v")))

    def row(members: Column) -> Column:
        good: Column = members.isNotNull()
        outputs = []
        for name, kind in fields:
            leaf = F.try_element_at(F.filter(members, _named(name)), F.lit(-1))["v"]
            shape = F.coalesce(F.schema_of_variant(leaf), F.lit("VOID"))
            wanted = "STRING" if kind == "STRING" else "BIGINT|DOUBLE|DECIMAL|TINYINT|SMALLINT|INT|FLOAT"
            good &= shape.rlike(f"^({wanted}|VOID)")
            blank = F.lit("") if kind == "STRING" else F.lit(0)
            picked = F.try_variant_get(leaf, "$", kind.lower())
            outputs.append(F.coalesce(picked, blank.cast(kind.lower())).alias(name))
        if strict:
            return F.when(good, F.struct(*outputs)).otherwise(
                F.raise_error(F.concat(F.lit("malformed line: "), F.coalesce(F.substring(F.col(value), 1, 200), F.lit("NULL"))))
            )
        return F.when(good, F.struct(*outputs))

    # A line becomes an array of one row or none, so it is parsed once and filtered on the way.
    keep = [c for c in lines.columns if c != value]
    return lines.select(*keep, F.inline(F.array_compact(F.array(let(folded, row)))))


def reviews(lines: DataFrame, strict: bool = False) -> DataFrame:
    return decode_json(lines, schemas.REVIEW, strict=strict)


def businesses(lines: DataFrame) -> DataFrame:
    """Businesses by id; of repeated ids the last line wins. Needs `line_no`."""
    rows = decode_json(lines, schemas.BUSINESS)
    return latest_per_key(rows, ["business_id"], [F.desc("line_no")]).drop("archive", "line_no")


def reviews_of(reviews_df: DataFrame, business_id: str) -> DataFrame:
    return reviews_df.filter(F.col("business_id") == business_id)
