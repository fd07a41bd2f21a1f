"""Labelled alert files: CSV with a header, and JSON lines."""

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.columns import iso_utc
from alertloom.operators.dataset import normalize_rows, remap_csv_rows
from alertloom.schemas import CONTEXT, UNIFIED_EVENT
from alertloom.sources.split_csv import read_split_csv


def read_labelled_csv(spark: SparkSession, path: str, now: datetime | Column, source: str = "public",
                      multi_line: bool = True) -> DataFrame:
    """Rows of a header CSV as events with context, label and violations.

    ``source="public"`` remaps the public dataset's columns; ``"raw"`` takes the
    intermediate names as they are.  All columns are read as text.  Quoted line breaks
    belong to their field; large files are split among tasks all the same.  With
    ``multi_line=False``, for sources that have none, Spark's own reader splits them.
    """
    if multi_line:
        rows = read_split_csv(spark, path)
    else:
        rows = spark.read.options(header=True, escape='"', inferSchema=False, ignoreLeadingWhiteSpace=False,
                                  ignoreTrailingWhiteSpace=False).csv(path)
    if source == "public":
        rows = remap_csv_rows(rows)
    elif source != "raw":
        raise ValueError(f"unknown CSV source {source!r}")
    return normalize_rows(rows, now)


def read_labelled_sources(spark: SparkSession, now: datetime | Column, public_csv: tuple[str, ...] = (),
                          raw_csv: tuple[str, ...] = (), lines: tuple[str, ...] = (), multi_line: bool = True) -> DataFrame:
    """All rows of several sources, in one set of columns."""
    frames = [read_labelled_csv(spark, p, now, "public", multi_line) for p in public_csv]
    frames += [read_labelled_csv(spark, p, now, "raw", multi_line) for p in raw_csv]
    frames += [read_labelled_lines(spark, p, now) for p in lines]
    return reduce(DataFrame.unionByName, frames)


# Any event column by name, its context columns and the label; everything as text
# except the technique list.
LINE_SCHEMA = T.StructType(
    [T.StructField(f.name, f.dataType if isinstance(f.dataType, T.ArrayType) else T.StringType())
     for f in UNIFIED_EVENT if f.name not in ("schema_version", "fields")]
    + [T.StructField(f"ctx_{f.name}", T.StringType()) for f in CONTEXT]
    + [T.StructField("native_label", T.StringType())]
)


def read_labelled_lines(spark: SparkSession, path: str, now: datetime | Column, strict: bool = True,
                        schema: T.StructType = LINE_SCHEMA) -> DataFrame:
    """Rows of a JSON-lines file; blank lines are skipped.

    Malformed JSON fails the job when ``strict``, else the row carries the violation
    ``not_json_object``.
    """
    lines = spark.read.text(path).where(F.trim("value") != "")
    keys = F.json_object_keys("value")
    if strict:
        keys = F.coalesce(keys, F.raise_error(F.lit("malformed JSON line")).cast("array<string>"))
    rows = lines.select(F.from_json("value", schema).alias("_r"), keys.alias("_keys"), F.try_parse_json("value").alias("_v"))
    # Only a JSON number is seconds since the epoch; the same digits as text are a date.
    number = F.when(F.schema_of_variant(F.try_variant_get("_v", "$.timestamp", "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
                    F.try_variant_get("_v", "$.timestamp", "double"))
    rows = rows.select("_r.*", "_keys", number.alias("_seconds"))
    if "timestamp" in rows.columns:
        rows = rows.withColumn("timestamp", F.coalesce(
            iso_utc(F.timestamp_micros(F.round(F.col("_seconds") * 1e6).cast("long"))), "timestamp"))
    rows = rows.drop("_seconds")
    # Whether a row brings any context is a property of the row here, not of the file.
    has_context = F.exists("_keys", lambda k: k.startswith("ctx_"))
    rows = rows.withColumn("ctx_lookup_degraded", F.coalesce(
        "ctx_lookup_degraded", (~has_context).cast("string"), F.lit("true")))
    out = normalize_rows(rows, now, carry=["_keys"])
    broken = F.when(F.col("_keys").isNull(), F.array(F.lit("not_json_object"))).otherwise(
        F.array().cast("array<string>"))
    return out.withColumn("violations", F.concat("violations", broken)).drop("_keys")
