"""Which triaged alerts become notifications."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.columns import present, severity_of
from alertloom.operators.sessions import GAP_S, sessionize

CONFIDENCE_THRESHOLD = 0.7
MAX_EVENT_AGE_S = 7200.0


def _age_seconds(now: datetime | Column) -> Column:
    now = F.lit(now) if isinstance(now, datetime) else now
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("timestamp").cast("timestamp"))) / 1e6


def decide(scored: DataFrame, now: datetime | Column, threshold: float = CONFIDENCE_THRESHOLD,
           max_age_s: float = MAX_EVENT_AGE_S, gap_s: int = GAP_S,
           open_sessions: DataFrame | None = None) -> DataFrame:
    """Sessions plus should_notify, flags and reason.

    Too old -> ``age_suppressed``.  A row is a candidate when its severity is high or
    critical, else when confidence is under the threshold, else when the class is
    alert.  Of a session's candidates that are not too old only the first notifies.
    """
    severe = severity_of("severity_hint").isin("high", "critical")
    unsure = F.col("confidence") < threshold
    aged = _age_seconds(now) > max_age_s
    candidate = severe | unsure | (F.col("classification") == "alert")
    flags = F.when(aged, F.array().cast("array<string>")).otherwise(present(
        F.when(severe, F.lit("severity_floor")),
        F.when(severe & (F.col("classification") == "noise"), F.lit("false_positive_candidate")),
        F.when(~severe & unsure, F.lit("low_confidence")),
    ))
    folded = sessionize(scored, gap_s, eligible=candidate & ~aged, open_sessions=open_sessions)
    reason = (
        F.when(aged, "age_suppressed")
        .when(~candidate, "not_candidate")
        .when(F.col("is_new_session"), "new_session")
        .when(~F.col("session_was_notified"), "intra_session_escalation")
        .otherwise("suppressed")
    )
    return (
        folded.withColumn("severity", severity_of("severity_hint"))
        .withColumn("flags", flags)
        .withColumn("reason", reason)
        .withColumn("should_notify", F.col("reason").isin("new_session", "intra_session_escalation"))
    )
