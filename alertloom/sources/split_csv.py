"""CSV files with line breaks inside quoted fields, read by as many tasks as there are file splits.

Where a record starts depends on whether a quote is open, which depends on all quotes before.  So every split counts its
quotes, and how many of its lines would start a record if no quote, or one, were open at its start.  Sums over a file's
splits, one small row each, tell what is open where.  Each line then knows its record's number; records of one line are
ready, the others' lines are brought together by (file, record), also over the ends of splits, and parsed.
"""

import csv

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertloom.session import stage

_SPLIT = ["file", "at"]
MOST_SPLITS = 1_000_000


def _quotes(column: pa.Array) -> np.ndarray:
    return pc.count_substring(pc.fill_null(column, ""), '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Stretches of a batch that lie in one split."""
    at, file = batch.column(1).to_numpy(zero_copy_only=False), batch.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((at[1:] != at[:-1]) | (file[1:] != file[:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)])) if len(at) else []


def _counted(batches):
    """(file, at, quotes, starts if no quote is open, starts if one is) of every split, possibly in parts."""
    key, quotes = None, 0
    for batch in batches:
        count = _quotes(batch.column(2))
        for lo, hi in _runs(batch):
            now = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
            if now != key:
                key, quotes = now, 0
            before = quotes + np.cumsum(count[lo:hi]) - count[lo:hi]
            even = int((before % 2 == 0).sum())
            quotes += int(count[lo:hi].sum())
            yield pa.RecordBatch.from_pylist([{"file": now[0], "at": now[1], "quotes": int(count[lo:hi].sum()), "even": even,
                                               "odd": hi - lo - even}])


def _numbered(batches):
    """(file, record, at, place, value, whole) of every line; reads (file, at, value, open, before)."""
    key = None
    for batch in batches:
        count, parts = _quotes(batch.column(2)), []
        for lo, hi in _runs(batch):
            now = (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py())
            if now != key:
                key, quotes, records, place = now, batch.column(3)[lo].as_py(), batch.column(4)[lo].as_py(), 0
            after = quotes + np.cumsum(count[lo:hi])
            start = (after - count[lo:hi]) % 2 == 0
            number = records + np.cumsum(start) - 1
            parts.append((number, np.arange(place, place + hi - lo), start & (after % 2 == 0)))
            quotes, records, place = int(after[-1]), int(number[-1]) + 1, place + hi - lo
        if parts:
            number, places, whole = map(np.concatenate, zip(*parts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(number), batch.column(1), pa.array(places), batch.column(2), pa.array(whole)],
                names=["file", "record", "at", "place", "value", "whole"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, record, value)``: the text of every record, numbered from 0 in its file; blank ones are left out."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")
    counts = lines.mapInArrow(_counted, "file string, at long, quotes long, even long, odd long").groupBy(*_SPLIT).agg(
        *(F.sum(c).alias(c) for c in ("quotes", "even", "odd")))
    in_file = Window.partitionBy("file").orderBy("at")
    opened = counts.withColumn("open", (F.sum("quotes").over(in_file) - F.col("quotes")) % 2)
    starts = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))
    entries = stage(opened.withColumn("starts", starts).select(
        *_SPLIT, "open", (F.sum("starts").over(in_file) - F.col("starts")).alias("before")), "csv-splits")
    if entries.limit(MOST_SPLITS + 1).count() > MOST_SPLITS:
        raise ValueError("too many file splits to broadcast: raise spark.sql.files.maxPartitionBytes")
    placed = lines.join(F.broadcast(entries), _SPLIT).select(*_SPLIT, "value", "open", "before").mapInArrow(
        _numbered, "file string, record long, at long, place long, value string, whole boolean")
    whole = placed.where("whole").select("file", "record", "value")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "place", "value"))), lambda s: s["value"]), "\n")
    parts = placed.where("not whole").groupBy("file", "record").agg(joined.alias("value"))
    return whole.unionByName(parts).withColumn("value", F.regexp_replace("value", r"\r\z", "")).where("value <> ''")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """All rows of header CSV files as text columns.  Files may differ in their header; quotes are doubled inside fields.

    A column that a file lacks is null there.  An empty folder of records gives a frame without columns.
    """
    records = csv_records(spark, path)
    first = records.groupBy("file").agg(F.min_by("value", "record").alias("header"), F.min("record").alias("top"))
    headers = stage(first, "csv-headers")
    options = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    rows = records.join(F.broadcast(headers), "file").where("record > top") if headers.limit(MOST_SPLITS).count() < MOST_SPLITS else (
        records.join(headers, "file").where("record > top"))
    out = None
    for (header,) in headers.select("header").distinct().orderBy("header").collect():  # as many as there are layouts
        names = next(csv.reader([header.lstrip("﻿")]))
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
        part = rows.where(F.col("header") == header).select(F.from_csv("value", schema, options).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "value string").drop("value")
