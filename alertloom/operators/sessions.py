"""Incident sessions: bursts of one source and rule, separated by quiet gaps.

An event joins its signature's open session when at most ``gap_s`` seconds passed
since the session's last event.  Time is event time.

Plan shape.  Two events inside one cell of ``gap_s`` seconds always belong together,
so sessions are decided on a summary of one row per (signature, cell), which Spark
pre-aggregates on the map side; a signature's summary is as long as the timeline,
however many alerts it holds.  Rows then look their cell up by (signature, cell),
which spreads a hot signature over the timeline.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import MICROS, cell_of, class_rank, micros, signature_key
from alertloom.schemas import require_columns

GAP_S = 300


def session_key(signature: Column) -> Column:
    return F.concat(F.lit("session:"), F.sha2(signature, 256))


def incident_key(signature: Column, first_us: Column) -> Column:
    seconds = cell_of(first_us, MICROS).cast("string")
    return F.sha1(F.concat_ws("|", signature, seconds))


def sessionize(df: DataFrame, gap_s: int = GAP_S, eligible: Column | None = None,
               open_sessions: DataFrame | None = None) -> DataFrame:
    """Adds session_key, incident_group_key, is_new_session, escalated, session_was_notified.

    ``eligible`` marks rows that would notify if their session had not yet; the first
    such row of a session is the one that notifies, later rows see
    ``session_was_notified``.  ``open_sessions`` (signature, first_us, last_us,
    opening_rank, notified) continues sessions from earlier batches.

    ``_signature``, ``_session_first_us`` and ``_opening_rank`` stay on the rows for callers
    that keep sessions open between batches.
    """
    require_columns(df, ["event_id", "timestamp", "classification"], "sessionize")
    gap_us = gap_s * MICROS
    us, rank = micros("timestamp"), class_rank("classification")
    if eligible is None:
        eligible = F.lit(False)
    rows = df.select(
        "*", signature_key().alias("_signature"), us.alias("_us"),
        cell_of(us, gap_us).alias("_cell"),
        F.coalesce(eligible, F.lit(False)).alias("_eligible"))
    spot = F.struct(F.col("_us").alias("us"), F.col("event_id").alias("id"))
    cells = rows.groupBy("_signature", "_cell").agg(
        F.min(F.struct(F.col("_us").alias("us"), F.col("event_id").alias("id"), rank.alias("rank"))).alias("_open"),
        F.max("_us").alias("_last"),
        F.min(F.when(F.col("_eligible"), spot)).alias("_hit"),
    )
    cells = session_cells(cells, gap_us, open_sessions)
    joined = rows.join(cells, ["_signature", "_cell"], "left")
    here = F.struct(F.col("_us").alias("us"), F.col("event_id").alias("id"))
    opening = F.col("_opening")
    is_new = ~F.col("_carried") & (F.struct(opening["us"].alias("us"), opening["id"].alias("id")) == here)
    was_notified = F.col("_carried_notified") | F.coalesce(F.col("_first_hit") < here, F.lit(False))
    return joined.select(
        *df.columns,
        session_key(F.col("_signature")).alias("session_key"),
        incident_key(F.col("_signature"), opening["us"]).alias("incident_group_key"),
        is_new.alias("is_new_session"),
        (~is_new & (class_rank("classification") > opening["rank"])).alias("escalated"),
        was_notified.alias("session_was_notified"),
        F.col("_signature"), opening["us"].alias("_session_first_us"),
        opening["rank"].alias("_opening_rank"),
    )


def session_cells(cells: DataFrame, gap_us: int, open_sessions: DataFrame | None = None) -> DataFrame:
    """Per (signature, cell): the opening row and first eligible row of the cell's session."""
    cells = cells.withColumns({"_carried": F.lit(False), "_carried_notified": F.lit(False),
                               "_reach": F.col("_last")})
    if open_sessions is not None:
        # A carried session sorts before every cell; it has no rows of its own here.
        carried = open_sessions.select(
            F.col("signature").alias("_signature"), F.lit(None).cast("long").alias("_cell"),
            F.struct(F.col("first_us").alias("us"), F.lit(None).cast(cells.schema["_open"].dataType["id"].dataType).alias("id"),
                     F.col("opening_rank").alias("rank")).alias("_open"),
            F.col("last_us").alias("_last"), F.lit(None).cast(cells.schema["_hit"].dataType).alias("_hit"),
            F.lit(True).alias("_carried"), F.col("notified").alias("_carried_notified"),
            F.col("last_us").alias("_reach"),
        ).join(cells.select("_signature").distinct(), "_signature", "left_semi")
        cells = cells.unionByName(carried)
    order = Window.partitionBy("_signature").orderBy(F.col("_cell").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("_reach").over(before)
    starts = reach.isNull() | (F.col("_open.us") - reach > gap_us)
    cells = cells.withColumn("_start", F.when(starts, F.struct("_open", "_carried", "_carried_notified")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("_session", F.last("_start", ignorenulls=True).over(upto))
    cells = cells.withColumn("_no", F.count("_start").over(upto))
    whole = Window.partitionBy("_signature", "_no")
    return cells.withColumn("_first_hit", F.min("_hit").over(whole)).where("_cell is not null").select(
        "_signature", "_cell", F.col("_session._open").alias("_opening"),
        F.col("_session._carried").alias("_carried"),
        F.col("_session._carried_notified").alias("_carried_notified"), "_first_hit")


def incident_rollup(decided: DataFrame) -> DataFrame:
    """One row per incident: span, size, highest class, whether it notified."""
    rank = class_rank("classification")
    return decided.groupBy("incident_group_key").agg(
        F.min("timestamp").alias("opened_at"),
        F.max("timestamp").alias("last_event_at"),
        F.count("*").alias("events"),
        F.max_by("classification", rank).alias("max_classification"),
        F.bool_or("should_notify").alias("notified"),
    )
