"""Watermarked aggregates over event streams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.functions.columns import signature_key
from alertloom.operators.sessions import GAP_S, incident_key, session_key
from alertloom.functions.columns import micros


def session_windows(events: DataFrame, gap_s: int = GAP_S) -> DataFrame:
    """One row per session of a batch or a watermarked stream.

    Spark closes a session when the gap after its last event is reached, not passed, so
    the window is one microsecond longer than the gap: an event exactly ``gap_s`` after
    the last one still joins, as in ``sessionize``.
    """
    window = F.session_window("timestamp", F.lit(f"{gap_s} seconds 1 microsecond"))
    grouped = events.groupBy(signature_key().alias("signature"), window.alias("w")).agg(
        F.count("*").alias("events"), F.max("timestamp").alias("last_event_at"))
    return grouped.select(
        session_key(F.col("signature")).alias("session_key"),
        incident_key(F.col("signature"), micros("w.start")).alias("incident_group_key"),
        F.col("w.start").alias("opened_at"), "last_event_at", "events")


def event_rate(events: DataFrame, by: list[str], width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Events per second and label in tumbling or sliding windows."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("events")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "events",
        (F.col("events") / seconds).alias("per_second"))
