"""Checked bundles of tables: CSV parts with a manifest of row counts and file digests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "textloom-bundle", 1
#: Rows a part holds at most, so that each digest reads a file of bounded size.
PART_ROWS = 1_000_000
CSV = {"header": "true", "quote": '"', "escape": '"', "nullValue": "\\N", "multiLine": "true"}


class BundleError(ValueError):
    """A bundle that does not match its manifest."""


def _digests(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def export(tables: dict[str, DataFrame], folder: str) -> None:
    """Writes each table as CSV parts, their digests as Parquet and one manifest row; nulls and empty texts stay apart."""
    spark = next(iter(tables.values())).sparkSession
    heads = []
    for name, df in tables.items():
        df.write.option("maxRecordsPerFile", PART_ROWS).options(**CSV).csv(f"{folder}/{name}")
        _digests(spark, f"{folder}/{name}").write.parquet(f"{folder}/_digests/{name}")
        rows = spark.read.schema(df.schema).options(**CSV, emptyValue="").csv(f"{folder}/{name}").count()
        heads.append({"name": name, "columns": df.columns, "rows": rows})
    head = json.dumps({"format": FORMAT, "version": VERSION, "tables": heads})
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{folder}/_manifest")


def load(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The bundle's tables, after format, columns, digests and row counts are found right; else BundleError."""
    head = json.loads(spark.read.text(f"{folder}/_manifest").first().value)
    if (head.get("format"), head.get("version")) != (FORMAT, VERSION):
        raise BundleError("unknown format or version")
    if {t["name"] for t in head["tables"]} != set(schemas):
        raise BundleError("other tables than asked for")
    out = {}
    for t in head["tables"]:
        name = t["name"]
        df = spark.read.schema(schemas[name]).options(**CSV, emptyValue="").csv(f"{folder}/{name}")
        if df.columns != t["columns"]:
            raise BundleError(f"{name}: other columns")
        was = spark.read.parquet(f"{folder}/_digests/{name}")
        now = _digests(spark, f"{folder}/{name}")
        if was.exceptAll(now).limit(1).count() or now.exceptAll(was).limit(1).count():
            raise BundleError(f"{name}: files differ from their digests")
        if df.count() != t["rows"]:
            raise BundleError(f"{name}: other row count")
        out[name] = df
    return out
