"""Streaming ingest: raw alerts to an event table and a quarantine table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.operators.contract import split_quarantine
from alertloom.operators.normalize import SOURCE_MODULE, normalize
from alertloom.sources.alerts import events_from_bus

POLL = "10 seconds"


def batch_dir(root: str, batch_id: int) -> str:
    """A micro-batch owns its folder: a replay overwrites it and changes nothing else."""
    return f"{root}/batch_id={batch_id}"


def start_ingest(raw: DataFrame, events_path: str, quarantine_path: str, checkpoint: str,
                 source_module: str = SOURCE_MODULE, available_now: bool = False) -> StreamingQuery:
    """Normalizes a raw stream.  Offsets live in ``checkpoint``; an unfinished batch replays."""

    def write(batch: DataFrame, batch_id: int) -> None:
        normalized = normalize(source_module, batch).persist()
        try:
            events, quarantine = split_quarantine(normalized)
            events.write.mode("overwrite").parquet(batch_dir(events_path, batch_id))
            quarantine.withColumn("quarantined_at", F.current_timestamp()).write.mode(
                "overwrite").parquet(batch_dir(quarantine_path, batch_id))
        finally:
            normalized.unpersist()

    return _start(raw, write, checkpoint, available_now)


def _start(df: DataFrame, write, checkpoint: str, available_now: bool, poll: str = POLL) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": poll}
    return writer.trigger(**trigger).start()


def valid_bus_events(messages: DataFrame, data: str = "data") -> DataFrame:
    """Valid events of a bus stream; what it leaves out is what :func:`bus_quarantine` holds."""
    return events_from_bus(messages, data).where(F.size("violations") == 0).drop("violations", "_raw")


def bus_quarantine(messages: DataFrame, data: str = "data") -> DataFrame:
    """Malformed messages of a bus stream: id if readable, broken rules and a digest, never the text."""
    return events_from_bus(messages, data).where(F.size("violations") > 0).select(
        "event_id", "source_module", "violations", F.sha2("_raw", 256).alias("message_sha256"))


def start_bus_ingest(messages: DataFrame, events_path: str, quarantine_path: str, checkpoint: str, data: str = "data",
                     available_now: bool = False) -> StreamingQuery:
    """Bus messages to an event table and a quarantine table, each message parsed once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = events_from_bus(batch, data).persist()
        try:
            ok = F.size("violations") == 0
            parsed.where(ok).drop("violations", "_raw").write.mode("overwrite").parquet(batch_dir(events_path, batch_id))
            parsed.where(~ok).select(
                "event_id", "source_module", "violations", F.sha2("_raw", 256).alias("message_sha256"),
                F.current_timestamp().alias("quarantined_at")).write.mode("overwrite").parquet(batch_dir(quarantine_path, batch_id))
        finally:
            parsed.unpersist()

    return _start(messages, write, checkpoint, available_now)


def dedupe_stream(events: DataFrame, delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Drops redelivered events.  State is kept only as long as the watermark allows."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["event_id"])
