"""Readers: line-wise and whole JSON, latest file, queue files, configuration."""

from __future__ import annotations

import glob
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _typed(variant: str, schema: T.StructType) -> list:
    """Typed fields of a variant column; a mistyped field is null, the row stays."""
    return [
        F.try_variant_get(F.col(variant), f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema.fields
    ]


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects, one per line; blank and malformed lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.try_parse_json("value").alias("v")).where(F.col("v").isNotNull())
    return parsed.select(*_typed("v", schema))


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The filled lines of a file that are no JSON."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull())


def read_json_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A document that is one array of objects, with their positions; anything else fails."""
    whole = spark.read.text(path, wholetext=True)
    array = F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})
    return whole.select(F.posexplode(array).alias("seq", "row")).select("seq", "row.*")


def latest_file(folder: str, explicit: str | None = None, patterns: tuple[str, ...] = ("*.jsonl", "*.ndjson")) -> str:
    """The named file, which must exist, else the last by path of those in a folder."""
    if explicit:
        if not os.path.exists(explicit):
            raise FileNotFoundError(explicit)
        return explicit
    found = sorted(p for pattern in patterns for p in glob.glob(os.path.join(folder, pattern)))
    if not found:
        raise FileNotFoundError(f"no {' or '.join(patterns)} in {folder}")
    return found[-1]


QUEUE_SCHEMA = "source string, query string, location string, pageNumber bigint, url string"


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """A queue file, one array or one object per line; malformed content fails, rows without url or source go."""
    fields = T.StructType.fromDDL(
        "source string, query string, search_query string, location string, search_location string, "
        "pageNumber bigint, result_page_number bigint, url string"
    )
    first = spark.read.text(path).where(F.trim("value") != "").select(F.left(F.ltrim("value"), F.lit(1))).head(1)
    if first and first[0][0] == "[":
        rows = read_json_document(spark, path, fields).drop("seq")
    else:
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select(F.from_json("value", fields, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    filled = lambda a, b: F.coalesce(F.when(F.col(a) != "", F.col(a)), F.col(b))
    return rows.where((F.col("url") != "") & (F.col("source") != "")).select(
        "source",
        filled("query", "search_query").alias("query"),
        filled("location", "search_location").alias("location"),
        F.coalesce(F.nullif("pageNumber", F.lit(0)), F.nullif("result_page_number", F.lit(0)), F.lit(1)).alias("pageNumber"),
        "url",
    )


def read_config(path: str) -> dict:
    """A YAML mapping."""
    import yaml

    with open(path, encoding="utf-8") as file:
        found = yaml.safe_load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    return found
