"""Metric samples: counters with closed label sets, written at points in time and read back as series."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.schemas import METRIC_SAMPLE, require_exactly


def counter_samples(counters: DataFrame, at: datetime | Column) -> DataFrame:
    """Samples of the pipeline's counters (name, label, label_value, count); an unlabelled one has an empty map."""
    at = F.lit(at) if isinstance(at, datetime) else at
    none = F.create_map().cast("map<string,string>")
    labels = F.when(F.col("label") == "", none).otherwise(F.create_map("label", "label_value"))
    return counters.select(at.cast("timestamp").alias("ts"), "name", labels.alias("labels"), F.col("count").cast("double").alias("value"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Appends samples by day, for scans to prune on ``day``."""
    out = require_exactly(samples, METRIC_SAMPLE, "samples").withColumn("day", F.to_date("ts"))
    out.write.mode("append").partitionBy("day").parquet(path)


def read_samples(spark: SparkSession, path: str, name: str | None = None, since: datetime | None = None) -> DataFrame:
    """Samples with ``series``: name and labels in label order, ``name{a="x",b="y"}``, the same for equal label sets."""
    rows = spark.read.parquet(path)
    if name is not None:
        rows = rows.where(F.col("name") == name)
    if since is not None:
        rows = rows.where((F.col("day") >= F.to_date(F.lit(since))) & (F.col("ts") >= F.lit(since)))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return rows.select(*METRIC_SAMPLE.names).withColumn("series", F.concat("name", F.lit("{"), F.array_join(pairs, ","), F.lit("}")))


def progress_samples(spark: SparkSession, query, job: str) -> DataFrame:
    """Samples of a streaming query's recent batches: rows read, and rows its state dropped behind the watermark."""
    rows = []
    for p in query.recentProgress:  # at most spark.sql.streaming.numRecentProgressUpdates
        at = datetime.fromisoformat(p["timestamp"].replace("Z", "+00:00"))
        rows.append((at, "stream_rows_read", {"job": job}, float(p["numInputRows"])))
        rows += [(at, "stream_rows_late", {"job": job, "operator": s.get("operatorName", str(i))}, float(s.get("numRowsDroppedByWatermark", 0)))
                 for i, s in enumerate(p["stateOperators"])]
    return spark.createDataFrame(rows, METRIC_SAMPLE)
