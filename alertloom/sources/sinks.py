"""Table and file writers."""

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from alertloom.operators.dedupe import dedupe_events
from alertloom.schemas import DEAD_LETTER, TRIAGE_RECORD, UNIFIED_EVENT, require_exactly
from alertloom.session import stage, written
from alertloom.sources.alerts import events_from_bus, events_to_bus

FEW = 200  # keys that are looked up one by one


@dataclass(frozen=True)
class KeyedTable:
    """A table that takes every key once.

    Rows lie in folders: by the day of ``day``, where a repeated key has the same time, else by ``buckets`` buckets of
    the key's hash.  Files hold a Bloom filter of their keys.  An append reads only the key column of the folders that
    its rows fall into, and of those, when it brings few keys, only row groups whose filter may hold one.
    """

    path: str
    key: str = "event_id"
    day: str | None = None
    buckets: int = 64

    @property
    def folder(self) -> str:
        return "event_date" if self.day else "bucket"

    def _place(self) -> Column:
        if self.day:
            return F.to_date(self.day)
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def stored(self, rows: DataFrame) -> DataFrame | None:
        """The stored keys among which those of ``rows`` would be; None before the first append."""
        spark = rows.sparkSession
        if not written(spark, self.path):
            return None
        folders = [r[0] for r in rows.select(self._place()).distinct().collect()]  # buckets, or the days of one append
        table = spark.read.parquet(self.path).where(F.col(self.folder).isin(folders))
        keys = [r[0] for r in rows.select(self.key).where(F.col(self.key).isNotNull()).distinct().limit(FEW + 1).collect()]
        if 0 < len(keys) <= FEW:
            table = table.where(reduce(or_, (F.col(self.key) == k for k in keys)))
        return table.select(self.key)

    def append(self, rows: DataFrame) -> None:
        """Adds the rows whose key is not stored yet.  The same rows again, whole or in part, change nothing."""
        rows = stage(rows, "append")
        fresh = new_records(rows, self.stored(rows), self.key)
        placed = fresh.withColumn(self.folder, self._place()).hint("rebalance", F.col(self.folder))
        (placed.sortWithinPartitions(self.folder, self.key).write.mode("append").partitionBy(self.folder)
         .option(f"parquet.bloom.filter.enabled#{self.key}", "true").parquet(self.path))

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(self.folder)


def new_records(records: DataFrame, stored: DataFrame | None, key: str = "event_id") -> DataFrame:
    """Records whose key is not stored yet: makes a replayed write harmless."""
    if stored is None:
        return records
    return records.join(stored.select(key), key, "left_anti").select(*records.columns)


def publish_events(events: DataFrame, path: str, quarantine_path: str) -> None:
    """Appends events by day, each once, as they come out of the bus's text form and its contract.

    What is written is what a reader would parse: rows that do not survive serialization or break the contract go to
    the quarantine with the broken rules and a digest, each once too.
    """
    parsed = stage(events_from_bus(events_to_bus(require_exactly(events, UNIFIED_EVENT, "events"))), "published")
    ok = F.size("violations") == 0
    KeyedTable(path, day="timestamp").append(dedupe_events(parsed.where(ok).select(*UNIFIED_EVENT.names)))
    bad = parsed.where(~ok).select("event_id", "source_module", "violations", F.sha2("_raw", 256).alias("message_sha256"))
    KeyedTable(quarantine_path, "message_sha256", buckets=16).append(bad.dropDuplicates(["message_sha256"]))


def append_dead_letters(records: DataFrame, path: str) -> None:
    """Dead letters have their own table and never mix with events; one per event."""
    KeyedTable(path).append(require_exactly(records, DEAD_LETTER, "dead letters"))


def persist_records(records: DataFrame, path: str) -> None:
    """Appends triage records; an event that has one already keeps it."""
    KeyedTable(path).append(require_exactly(records, TRIAGE_RECORD, "triage records"))


def write_json_lines(df: DataFrame, path: str, column: str | None = None) -> int:
    """One JSON object per line; returns how many lines, counted by the write itself."""
    text = F.col(column) if column else F.to_json(F.struct(*df.columns))
    seen = Observation()
    df.select(text.alias("value")).observe(seen, F.count(F.lit(1)).alias("lines")).write.text(path)
    return seen.get["lines"]
