"""Continuous triage: the batch operators on micro-batches, with state as versioned tables.

State of batch N lives under ``.../batch_id=N`` and is computed from versions below N
only.  A batch that dies half-way replays from its checkpoint and overwrites its own
folders, so delivery is effectively once and a lost executor costs one batch at most.

Tables under ``root``:

* ``alerts``   slim history rows, by batch and day
* ``slots``    slot summaries of the history, by batch and day
* ``findings`` alert and event ids that have a record, by batch
* ``records``, ``dead_letters``, ``decided``, ``notices``: the output
* ``sessions`` sessions still open, rewritten per batch (as long as the gap, not the past)
* ``windows``  coalescing windows still open
* ``clock``    median event times of the last few batches

Every ``FOLD`` batches the versions of the first three are folded into one (``.../upto=N``): slots of one key, rule and
slot add up, an alert id keeps its lowest and highest event id, and days that no look-back reaches any more are left
out.  The folded versions are then removed, as are all but the last two of the other state tables, so a batch
opens at most ``FOLD`` versions of a table and one fold, however long the stream has run.
"""

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from alertloom.functions.columns import MICROS, micros
from alertloom.operators.dedupe import dedupe_events
from alertloom.operators.history import SEEN_S, edge_slots, reaching_slots, slot_summary
from alertloom.operators.notices import coalesce_notices
from alertloom.operators.scoring import Scorer, rubric_scorer
from alertloom.operators.sessions import GAP_S
from alertloom.plans.triage import Triage, triage
from alertloom.schemas import UNIFIED_EVENT, columns
from alertloom.session import remove, scratch, stage, written
from alertloom.streaming.ingest import POLL, _start, batch_dir

HISTORY_COLUMNS = ["event_id", "timestamp", "sensor", "src_ip", "rule_id", "signature", "event_type"]
_S, _L, _TS = T.StringType(), T.LongType(), T.TimestampType()
SESSIONS = columns(signature=_S, first_us=_L, last_us=_L, opening_rank=T.IntegerType(), notified=T.BooleanType())
WINDOWS = columns(reason=_S, sensor=_S, opened_at=_TS, count=_L)
FIRED = columns(reason=_S, sensor=_S, fired_at=_TS, count=_L)
CLOCK = columns(at_us=_L)
CLOCK_BATCHES = 5
SLOTS = columns(key=_S, rule=_S, slot=_L, n=_L, first_us=_L, last_us=_L)
FOLD = 16
FOLDED = {  # state tables that grow, with the columns they are stored with
    "alerts": T.StructType([UNIFIED_EVENT[c] for c in HISTORY_COLUMNS] + [T.StructField("event_date", T.DateType())]),
    "slots": T.StructType([*SLOTS, T.StructField("event_date", T.DateType())]),
    "findings": columns(alert_id=_S, event_id=_S),
}


@dataclass
class TriageStream:
    """Triage of a stream of unified events.

    ``now`` gives the decision time of a batch's rows (default: the wall clock).
    ``lateness_s`` is how long after its last event a session is still kept, beyond the gap.
    """

    spark: SparkSession
    root: str
    scorer: Scorer = rubric_scorer
    allowlist: str | list[str] | DataFrame | None = None
    now: Column | datetime | None = None
    gap_s: int = GAP_S
    max_age_s: float = 7200.0
    threshold: float = 0.7
    lateness_s: int = 600
    notice_window_s: int = 60

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False,
              poll: str = POLL) -> StreamingQuery:
        return _start(events, self.process, checkpoint, available_now, poll)

    def table(self, name: str, before: int | None = None) -> DataFrame | None:
        """All versions of a table, or those below a batch; None when there are none yet."""
        if before == 0:
            return None
        df = self.spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")
        return df if before is None else df.where(F.col("batch_id") < before)

    def _version(self, name: str, schema: T.StructType, batch_id: int) -> DataFrame | None:
        if batch_id == 0:
            return None
        return self.spark.read.schema(schema).parquet(batch_dir(f"{self.root}/{name}", batch_id - 1))

    def _state(self, name: str, before: int) -> DataFrame:
        """A growing state table as of a batch: the last fold and the versions since."""
        fold = before // FOLD * FOLD
        paths = [batch_dir(f"{self.root}/{name}", n) for n in range(fold, before)]
        if fold:
            paths.append(f"{self.root}/{name}-folded/upto={fold}")
        return reduce(DataFrame.unionByName, (self.spark.read.schema(FOLDED[name]).parquet(p) for p in paths))

    def _fold(self, batch_id: int, lo: datetime | None) -> None:
        """Makes one version of all before a batch.  A fold that died is made again: its sources go last."""
        for name in FOLDED:
            target = f"{self.root}/{name}-folded/upto={batch_id}"
            if not written(self.spark, target):
                rows = self._unfolded(name, batch_id)
                if "event_date" in rows.columns and lo is not None:
                    rows = rows.where(F.col("event_date") >= F.to_date(F.lit(lo) - F.expr(f"interval {2 * SEEN_S} seconds")))
                if name == "slots":
                    rows = rows.groupBy("key", "rule", "slot", "event_date").agg(
                        F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))
                elif name == "findings":
                    ends = F.array_distinct(F.array(F.min("event_id"), F.max("event_id")))
                    rows = rows.groupBy("alert_id").agg(ends.alias("e")).select("alert_id", F.explode("e").alias("event_id"))
                writer = rows.write.mode("overwrite")
                (writer.partitionBy("event_date") if "event_date" in rows.columns else writer).parquet(target)
            remove(self.spark, f"{self.root}/{name}-folded/upto={batch_id - FOLD}",
                   *(batch_dir(f"{self.root}/{name}", n) for n in range(batch_id - FOLD, batch_id)))

    def _unfolded(self, name: str, batch_id: int) -> DataFrame:
        start = batch_id - FOLD
        paths = [batch_dir(f"{self.root}/{name}", n) for n in range(start, batch_id)]
        if start:
            paths.append(f"{self.root}/{name}-folded/upto={start}")
        return reduce(DataFrame.unionByName, (self.spark.read.schema(FOLDED[name]).parquet(p) for p in paths))

    def _write(self, df: DataFrame, name: str, batch_id: int, by_day: bool = False) -> None:
        if by_day:  # a day's rows are brought together first, or every task would write a file for each of its days
            df = df.hint("rebalance", "event_date")
        writer = df.write.mode("overwrite")
        if by_day:
            writer = writer.partitionBy("event_date")
        writer.parquet(batch_dir(f"{self.root}/{name}", batch_id))

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.spark = batch.sparkSession
        batch = batch.persist()
        try:
            span = batch.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).first()
            if batch_id and batch_id % FOLD == 0:
                self._fold(batch_id, span["lo"])
            past = self._past_alerts(batch_id, span["lo"], span["hi"])
            events = dedupe_events(batch)
            if past is not None:  # an event redelivered in a later batch is already stored
                days = F.col("event_date").between(
                    F.to_date(F.lit(span["lo"])), F.to_date(F.lit(span["hi"])))
                events = events.join(past.where(days), "event_id", "left_anti").select(*batch.columns)
            # Written, not cached: a cached frame keeps every shuffle partition, as one task in each of its readers.
            with scratch(self.spark):
                self._triage(stage(events, "events"), past, span["lo"], span["hi"], batch_id)
        finally:
            batch.unpersist()

    def _past_alerts(self, batch_id: int, lo: datetime | None, hi: datetime | None) -> DataFrame | None:
        if batch_id == 0 or lo is None:
            return None
        return self._state("alerts", batch_id).where(self._in_reach(lo, hi))

    @staticmethod
    def _in_reach(lo: datetime, hi: datetime) -> Column:
        """Days a look-back from [lo, hi] can touch; prunes the day folders."""
        first = F.to_date(F.lit(lo) - F.expr(f"interval {SEEN_S} seconds"))
        return F.col("event_date").between(first, F.to_date(F.lit(hi)))

    def _triage(self, events: DataFrame, past: DataFrame | None, lo: datetime | None,
                hi: datetime | None, batch_id: int) -> None:
        slim = events.select(*HISTORY_COLUMNS, F.to_date("timestamp").alias("event_date"))
        self._write(slim, "alerts", batch_id, by_day=True)
        slot_day = F.to_date(F.timestamp_micros("first_us"))
        self._write(slot_summary(events).withColumn("event_date", slot_day), "slots", batch_id, by_day=True)
        mine = self.spark.read.schema(FOLDED["slots"]).parquet(batch_dir(f"{self.root}/slots", batch_id)).select(*SLOTS.names)

        history, past_slots, done, since = events.select(*HISTORY_COLUMNS), mine, None, None
        if past is not None:
            edges = edge_slots(micros(F.lit(lo)), micros(F.lit(hi)), micros("timestamp"))
            history = history.unionByName(past.where(edges).select(*HISTORY_COLUMNS))
            since = micros(F.lit(lo))
            past_slots = reaching_slots(mine.unionByName(
                self._state("slots", batch_id).where(self._in_reach(lo, hi)).select(*SLOTS.names)), since)
            ids = events.where("event_type = 'finding'").select(F.col("source_alert_id").alias("alert_id")).distinct()
            done = self._state("findings", batch_id).join(ids, "alert_id", "left_semi")

        open_before = self._version("sessions", SESSIONS, batch_id)
        run = triage(
            events, history, self.now if self.now is not None else F.current_timestamp(),
            scorer=self.scorer, triaged=done, allowlist=self.allowlist, threshold=self.threshold,
            max_age_s=self.max_age_s, gap_s=self.gap_s, open_sessions=open_before, past_slots=past_slots,
            since=since)
        self._write(run.records, "records", batch_id)
        self._write(run.decided.select(F.col("source_alert_id").alias("alert_id"), "event_id"), "findings", batch_id)
        self._write(run.dead_letters, "dead_letters", batch_id)
        self._write(run.decided, "decided", batch_id)
        horizon = self._horizon(run, batch_id)
        self._write(self._open_sessions(run, open_before, horizon), "sessions", batch_id)
        fired, still_open = coalesce_notices(
            run.notices, window_s=self.notice_window_s,
            open_windows=self._version("windows", WINDOWS, batch_id))
        self._write(fired.select(*FIRED.names), "notices", batch_id)
        self._write(still_open.select(*WINDOWS.names), "windows", batch_id)
        remove(self.spark, *(batch_dir(f"{self.root}/{name}", batch_id - 2) for name in ("sessions", "windows", "clock")))

    def _horizon(self, run: Triage, batch_id: int) -> int | None:
        """The time the stream has reached: the lower median of the last batches' median event times.

        Neither a row nor a batch with a wrong clock moves it past the others' time.
        """
        before = self._version("clock", CLOCK, batch_id)
        known = [] if before is None else [r["at_us"] for r in before.collect()]  # CLOCK_BATCHES rows at most
        middle = run.decided.agg(F.percentile_approx(micros("timestamp"), 0.5)).first()[0]
        known = known[-(CLOCK_BATCHES - 1):] + ([] if middle is None else [middle])
        self._write(self.spark.createDataFrame([(t,) for t in known], CLOCK).coalesce(1), "clock", batch_id)
        return sorted(known)[(len(known) - 1) // 2] if known else None

    def _open_sessions(self, run: Triage, before: DataFrame | None, horizon: int | None = None) -> DataFrame:
        """Each signature's latest session, forgotten once no event can join it any more (all are kept without a horizon)."""
        rows = run.decided.select(
            F.col("_signature").alias("signature"), F.col("_session_first_us").alias("first_us"),
            micros("timestamp").alias("last_us"), F.col("_opening_rank").alias("opening_rank"),
            (F.col("should_notify") | F.col("session_was_notified")).alias("notified"))
        if before is not None:
            rows = rows.unionByName(before)
        sessions = rows.groupBy("signature", "first_us").agg(
            F.max("last_us").alias("last_us"), F.max("opening_rank").alias("opening_rank"),
            F.bool_or("notified").alias("notified"))
        latest = sessions.groupBy("signature").agg(
            F.max_by(F.struct(*SESSIONS.names[1:]), "last_us").alias("s")).select("signature", "s.*")
        if horizon is None:
            return latest
        return latest.where(F.col("last_us") >= horizon - (self.gap_s + self.lateness_s) * MICROS)
