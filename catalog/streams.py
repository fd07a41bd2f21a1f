"""Queries that run the given tables as streams, to completion."""

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from alertloom.schemas import UNIFIED_EVENT
from alertloom.session import fresh_path, stage
from alertloom.sources.alerts import events_to_bus
from alertloom.streaming.ingest import dedupe_stream, start_bus_ingest, start_ingest, valid_bus_events
from alertloom.streaming.late import LateSplit, late_counts
from alertloom.streaming.triage import TriageStream
from alertloom.streaming.windows import event_rate, session_windows
from catalog.base import ALERTS_SQL, ALLOWLIST, DECIDED_SQL, alerts, decision_time, micros_of, varied_scorer
from catalog.ingest import BUS_SQL, bus_messages, raw_alerts
from catalog.ingest import ORACLES as INGEST_ORACLES

PART_DAYS = 10
_LATE = "case when event_no % 29 = 0 then 3 * 86400 when event_no % 31 = 0 then 480 else 0 end"


def deliveries(rows, at=None):
    """Adds ``part``, the delivery a row comes with: ten days of its event time, or of another time."""
    at = F.col("timestamp") if at is None else at
    return rows.withColumn("part", F.coalesce(F.floor(F.unix_micros(at) / (PART_DAYS * 86_400_000_000)), F.lit(-1)))


def out_of_order(spark, d):
    """Alerts of which some arrive minutes and some days after their time."""
    a = alerts(spark, d)
    return deliveries(a, F.timestamp_micros(F.unix_micros("timestamp") + F.expr(_LATE).cast("long") * 1_000_000))


def played(spark, rows, start, fmt="parquet", restarts=0):
    """Puts the deliveries into a folder one by one and lets ``start(stream)`` run over what is new, to the end.

    A delivery is as many files as its size asks for.  A run that fails is started again ``restarts`` times.
    """
    rows, path = stage(rows, "deliveries"), fresh_path(spark, "stream-in")
    schema = rows.drop("part").schema
    for (part,) in rows.select("part").distinct().orderBy("part").collect():  # a few
        rows.where(F.col("part") == part).drop("part").write.option("maxRecordsPerFile", 250_000).mode("append").format(fmt).save(path)
        while True:
            try:
                start(spark.readStream.schema(schema).format(fmt).load(path)).awaitTermination()
                break
            except StreamingQueryException:
                if not restarts:
                    raise
                restarts -= 1


def drained(spark, rows, build, mode="append"):
    """What a streaming result has written after all deliveries."""
    out, state = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-state")

    def write(batch, batch_id):
        version = batch_id if mode == "append" else 0
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={version}")

    played(spark, rows, lambda s: build(s).writeStream.outputMode(mode).foreachBatch(write).option(
        "checkpointLocation", state).trigger(availableNow=True).start())
    return spark.read.parquet(out).drop("batch_id")


def ingest(spark, d):
    raw = raw_alerts(spark, d).withColumn("part", F.coalesce(F.pmod(F.crc32("id"), F.lit(3)), F.lit(0)))
    events, bad, state = (fresh_path(spark, n) for n in ("events", "quarantine", "ingest-state"))
    played(spark, raw, lambda s: start_ingest(s, events, bad, state, available_now=True), "json")
    good = spark.read.parquet(events).select("event_id", F.lit("").alias("violations"))
    return good.unionByName(spark.read.parquet(bad).select(
        "event_id", F.array_join("violations", ",").alias("violations")))


def dedupe(spark, d):
    """Each event twice within minutes; those that come behind the watermark are dropped."""
    out = drained(spark, out_of_order(spark, d), lambda s: dedupe_stream(s.unionByName(s)).select("event_id", "timestamp"))
    return micros_of(out, "timestamp")


def late_split(spark, d):
    split, state = LateSplit(fresh_path(spark, "late-split")), fresh_path(spark, "late-state")
    played(spark, out_of_order(spark, d), lambda s: split.start(s, state, available_now=True))
    return split


def late_rows(spark, d):
    """Every event, on time or by how much it missed the watermark."""
    split = late_split(spark, d)
    on_time = split.table(spark, "on_time").select("event_id", F.lit(False).alias("late"), F.lit(None).cast("long").alias("late_by"))
    late = split.table(spark, "late")
    return on_time.unionByName(late.select(
        "event_id", F.lit(True).alias("late"), (F.unix_micros("watermark") - F.unix_micros("timestamp")).alias("late_by")))


def late_totals(spark, d):
    counts = late_counts(late_split(spark, d).table(spark, "late"), "sensor")
    return counts.select(F.col("batch_id").cast("long").alias("batch_id"), "sensor", "late_rows", F.round("most_late_s", 6).alias("most_late_s"))


def watermarked(s):
    return s.withWatermark("timestamp", "10 minutes")


def sessions(spark, d):
    out = drained(spark, deliveries(alerts(spark, d)), lambda s: session_windows(watermarked(s), 6 * 3600), "complete")
    return micros_of(out, "opened_at", "last_event_at")


def rates(spark, d):
    out = drained(spark, deliveries(alerts(spark, d)), lambda s: event_rate(
        watermarked(s), ["event_type"], "1 hour", "30 minutes"), "complete")
    return micros_of(out, "window_start", "window_end").withColumn("per_second", F.round("per_second", 9))


def bus(spark, d):
    a = alerts(spark, d)
    messages = events_to_bus(a.select(*[c for c in UNIFIED_EVENT.names if c in a.columns]))
    rows = deliveries(messages, F.get_json_object("data", "$.timestamp").cast("timestamp"))
    return micros_of(drained(spark, rows, valid_bus_events), "timestamp").select(
        "event_id", "timestamp", "sensor", "summary")


def closed_sessions(spark, d):
    """Append mode: a session is written once, when the watermark has passed its end, and its state is released."""
    out = drained(spark, deliveries(alerts(spark, d)), lambda s: session_windows(watermarked(s), 6 * 3600))
    return micros_of(out, "opened_at", "last_event_at")


def closed_rates(spark, d):
    """Append mode over late rows: one counts in the windows that are still open when it comes."""
    out = drained(spark, out_of_order(spark, d), lambda s: event_rate(watermarked(s), ["event_type"], "1 hour", "30 minutes"))
    return micros_of(out, "window_start", "window_end").withColumn("per_second", F.round("per_second", 9))


def bus_quarantined(spark, d):
    """Damaged messages through the bus ingest: the good ones in one table, the others in the quarantine."""
    rows = deliveries(bus_messages(spark, d)).select("data", "part")
    events, bad, state = (fresh_path(spark, n) for n in ("events", "quarantine", "bus-state"))
    played(spark, rows, lambda s: start_bus_ingest(s, events, bad, state, available_now=True))
    good = spark.read.parquet(events).select("event_id", "sensor", F.lit("").alias("violations"))
    return good.unionByName(spark.read.parquet(bad).select(
        "event_id", F.lit(None).cast("string").alias("sensor"), F.array_join("violations", ",").alias("violations")))


def triaged(spark, d, scorer=varied_scorer, restarts=0):
    root, state = fresh_path(spark, "triage"), fresh_path(spark, "triage-state")
    stream = TriageStream(spark, root, scorer=scorer, allowlist=ALLOWLIST, now=decision_time())
    played(spark, deliveries(alerts(spark, d)), lambda s: stream.start(s, state, available_now=True), restarts=restarts)
    return stream


def triage_decisions(spark, d):
    return triaged(spark, d).table("decided").select(
        "event_id", "classification", "incident_group_key", "is_new_session", "escalated", "session_was_notified",
        "reason", "context.*")


def triage_outage(spark, d):
    """The scorer is down during the second batch: nothing is lost, dead-lettered or written twice, the batch comes again."""
    calls = []

    def scorer(rows):
        calls.append(1)
        if len(calls) == 2:
            raise ConnectionError("scorer is down")
        return varied_scorer(rows)

    stream = triaged(spark, d, scorer, restarts=1)
    answered = stream.table("decided").select("event_id", "classification", "reason")
    return answered.unionByName(stream.table("dead_letters").select(
        "event_id", F.lit(None).cast("string").alias("classification"), "reason"))


def stream_notices(spark, d):
    """Health notices of the stream, their windows carried over batches."""
    return micros_of(triaged(spark, d).table("notices").drop("batch_id"), "fired_at")


QUERIES = {
    "stream_ingest": ingest,
    "stream_dedupe": dedupe,
    "stream_late_rows": late_rows,
    "stream_late_counts": late_totals,
    "stream_sessions": sessions,
    "stream_event_rate": rates,
    "stream_sessions_append": closed_sessions,
    "stream_event_rate_append": closed_rates,
    "stream_bus": bus,
    "stream_bus_quarantine": bus_quarantined,
    "stream_triage": triage_decisions,
    "stream_scorer_outage": triage_outage,
    "stream_notices": stream_notices,
}

from catalog.health import ORACLES as HEALTH_ORACLES  # noqa: E402
from catalog.triage import _CTX, _coalesced, ORACLES as TRIAGE_ORACLES  # noqa: E402

# What the watermark has passed at the end: the last event's millisecond less the delay.
_PASSED = "(select max(epoch_us(ts)) // 1000 * 1000 - 600000000 from events)"
_NO_LOSS = DECIDED_SQL.replace("event_no % 23 = 0", "false").replace("event_no % 23 <> 0", "true")

# Deliveries, and the watermark each meets: the latest time of all before it less ten minutes, by the millisecond.
_DELIVERED = f"""{ALERTS_SQL},
 parts as (select *, (us + ({_LATE})::bigint * 1000000) // {PART_DAYS * 86_400_000_000} as part from alerts),
 marks as (select part, dense_rank() over (order by part) - 1 as batch_id,
   max(max(us)) over (order by part rows between unbounded preceding and 1 preceding) // 1000 * 1000 - 600000000 as mark
   from parts group by part),
 delivered as (select parts.*, batch_id, mark, coalesce(us <= mark, false) as late from parts join marks using (part))"""
_SENT = """select 'parse_failure' as reason, sensor, us, row_number() over (partition by sensor order by us, event_no) as rn
    from alerts where event_no % 19 = 0 union all
  select 'age_suppressed', sensor, us, row_number() over (partition by sensor order by us, event_no)
    from alerts where event_no % 19 <> 0 and event_no % 4 = 3"""

ORACLES = {
    "stream_ingest": f"select event_id, violations from ({INGEST_ORACLES['normalize_alerts']})",
    "stream_dedupe": f'with {_DELIVERED} select event_id, us as "timestamp" from delivered where not late',
    "stream_late_rows": f"with {_DELIVERED} select event_id, late, case when late then mark - us end as late_by from delivered",
    "stream_late_counts": f"""with {_DELIVERED} select batch_id, sensor, count(*) as late_rows, round(max(mark - us) / 1e6, 6) as most_late_s
      from delivered where late group by batch_id, sensor""",
    "stream_scorer_outage": f"""with {_NO_LOSS} select event_id, classification, reason from decided
      union all select event_id, null, 'parse_failure' from alerts where event_no % 19 = 0""",
    "stream_notices": f"""with recursive {ALERTS_SQL},{_coalesced(60, _SENT)}
      select reason, sensor, at_us as fired_at, fired as count from chain where fired is not null""",
    "stream_sessions": TRIAGE_ORACLES["session_windows"],
    "stream_event_rate": HEALTH_ORACLES["event_rate_sliding"],
    "stream_sessions_append": f"select * from ({TRIAGE_ORACLES['session_windows']}) where last_event_at + {6 * 3600 * 1_000_000 + 1} <= {_PASSED}",
    "stream_event_rate_append": f"""with {_DELIVERED},
      pairs as (select event_type, mark, us // 1800000000 * 1800000000 - s * 1800000000 as window_start from delivered, (values (0), (1)) t(s))
      select window_start, window_start + 3600000000 as window_end, event_type, count(*) as events, round(count(*) / 3600.0::double, 9) as per_second
      from pairs where window_start + 3600000000 > coalesce(mark, 0) and window_start + 3600000000 <= {_PASSED} group by all""",
    "stream_bus": f'with {ALERTS_SQL} select event_id, us as "timestamp", sensor, summary from alerts',
    "stream_bus_quarantine": f"""{BUS_SQL} select event_id, case when violations = '' then sensor end as sensor, violations from bus""",
    "stream_triage": f"""with {_NO_LOSS} select event_id, classification, incident_group_key, is_new_session, escalated,
      session_was_notified, reason, {_CTX} from decided""",
}
