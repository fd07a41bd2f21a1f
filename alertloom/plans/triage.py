"""Alerts to triage records, dead letters, incidents and notification outboxes."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.operators import decide as _decide
from alertloom.operators.history import enrich, with_batch_findings
from alertloom.operators.notices import (
    coalesce_notices, fan_out, project_notifications, system_notices)
from alertloom.operators.render import render_notification, render_system_notice, slack_payload
from alertloom.operators.scoring import (
    Scorer, dead_letters, resolve_attempts, rubric_scorer, scored_rows, triage_records)
from alertloom.operators.sessions import GAP_S, incident_rollup
from alertloom.session import stage


Enricher = Callable[[DataFrame], DataFrame]


@dataclass
class Triage:
    """Frames of one run.  ``answers`` and ``decided`` are tables when staged.

    ``resolved`` is ``answers`` with the findings of the run itself in its context.  What asks for neither of them reads
    ``answers``, so that the findings are joined once, for ``decided``.
    """

    resolved: DataFrame
    decided: DataFrame
    now: datetime | Column
    answers: DataFrame | None = None

    @property
    def dead_letters(self) -> DataFrame:
        return dead_letters(self.answers, self.now)

    @property
    def records(self) -> DataFrame:
        return triage_records(self.decided, self.now)

    @property
    def incidents(self) -> DataFrame:
        return incident_rollup(self.decided)

    @property
    def notifications(self) -> DataFrame:
        return project_notifications(self.decided)

    @property
    def notices(self) -> DataFrame:
        """Health notices at event time, before coalescing."""
        failed = dead_letters(self.answers, F.col("timestamp"))
        degraded = self.answers.where("context.lookup_degraded")
        return system_notices(failed, degraded, self.decided.where("reason = 'age_suppressed'"))


def triage(events: DataFrame, history: DataFrame | None, now: datetime | Column, *,
           scorer: Scorer = rubric_scorer, triaged: DataFrame | None = None,
           allowlist: str | list[str] | DataFrame | None = None, degraded: Column | None = None,
           threshold: float = _decide.CONFIDENCE_THRESHOLD, max_age_s: float = _decide.MAX_EVENT_AGE_S,
           gap_s: int = GAP_S, open_sessions: DataFrame | None = None,
           past_slots: DataFrame | None = None, staged: bool = True, enrichers: tuple[Enricher, ...] = (),
           since: Column | None = None) -> Triage:
    """Enrich, score, resolve, group and decide.

    The scored rows feed the session summary, the session join and the dead letters, and
    the decided rows every sink; ``staged`` writes each once instead of recomputing it.

    A finding counts as seen if a record of another event of its alert is in ``triaged``, or an earlier event of
    this run got a valid answer.  The scorer sees the former; the latter is known once the answers are judged.
    ``enrichers`` add columns of their own to the rows with their context, for the scorer and for what follows.
    """
    enriched = enrich(events, history, triaged, allowlist, degraded, past_slots, within=False, since=since)
    for enricher in enrichers:
        enriched = enricher(enriched)
    answers = resolve_attempts(scorer(enriched))
    if staged:
        answers = stage(answers, "resolved")
    resolved = with_batch_findings(answers)
    decided = _decide.decide(scored_rows(resolved), now, threshold, max_age_s, gap_s, open_sessions)
    if staged:
        decided = stage(decided, "decided")
    return Triage(resolved, decided, now, answers)


def notification_outbox(notifications: DataFrame, channels: tuple[str, ...] = ("slack", "telegram")) -> DataFrame:
    """One rendered row per notification and channel."""
    texts = {"slack": slack_payload(render_notification(markup=True)),
             "telegram": render_notification(markup=False)}
    return fan_out(notifications, {c: texts[c] for c in channels})


def notice_outbox(notices: DataFrame, channels: tuple[str, ...] = ("slack", "telegram"),
                  window_s: int = 60) -> DataFrame:
    """Coalesced health notices, rendered.  What a fired notice says is its own row's text."""
    fired, _ = coalesce_notices(notices, window_s=window_s)
    # The notice that fires is the first of its key at that instant.
    own = notices.groupBy("reason", "sensor", F.col("at").alias("fired_at")).agg(
        F.min(F.struct("kind", "severity", "retry_count", "detail")).alias("n"))
    said = fired.join(own, ["reason", "sensor", "fired_at"]).select(
        "reason", "sensor", "fired_at", "count", "n.*")
    text = render_system_notice("count")
    texts = {"slack": slack_payload(text), "telegram": text}
    return fan_out(said, {c: texts[c] for c in channels})
