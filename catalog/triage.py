"""Queries over scoring, sessions, decisions, notifications and health notices."""

from pyspark.sql import functions as F

from alertloom.functions.columns import class_rank, severity_of
from alertloom.operators.decide import decide
from alertloom.operators.history import enrich
from alertloom.operators.metrics import pipeline_counters
from alertloom.operators.notices import age_notices, coalesce_notices, dead_letter_notices, degradation_notices
from alertloom.operators.scoring import (
    dead_letters, resolve_attempts, retrying, rubric_label, rubric_scorer, validate_output)
from alertloom.operators.sessions import incident_rollup, sessionize
from alertloom.plans.triage import notice_outbox, notification_outbox, triage
from alertloom.schemas import CONTEXT, NOTIFICATION
from alertloom.streaming.windows import session_windows
from catalog.ingest import _NORMAL_SQL, normalized
from catalog.base import (
    ALERTS_SQL, ALLOWLIST, DECIDED_SQL, NOTIFIES, SCORED_SQL, alerts, decision_time,
    micros_of, sessions_sql, table, varied_scorer)



def enriched(spark, d):
    a = alerts(spark, d)
    return enrich(a, a, allowlist=ALLOWLIST, degraded=F.col("event_no") % 23 == 0)


def run(spark, d, **options):
    a = alerts(spark, d)
    return triage(a, a, decision_time(), scorer=varied_scorer, allowlist=ALLOWLIST,
                  degraded=F.col("event_no") % 23 == 0, **options)


def rubric(spark, d):
    return enriched(spark, d).select("event_id", rubric_label().alias("label"))


def rubric_answers(spark, d):
    out = resolve_attempts(rubric_scorer(enriched(spark, d)))
    return out.select("event_id", "output.classification", "output.confidence", "output.summary")


def classed(spark, d):
    """Alerts with a class taken from their severity, for session queries that need no history."""
    a = alerts(spark, d)
    return a.withColumn("classification", F.when(a.severity_hint.isin("high", "critical"), "alert").when(
        a.severity_hint == "medium", "informational").otherwise("noise"))


def sessions(gap_s):
    def q(spark, d):
        return sessionize(classed(spark, d), gap_s).select(
            "event_id", "session_key", "incident_group_key", "is_new_session", "escalated")
    return q


def windows(spark, d):
    return micros_of(session_windows(alerts(spark, d), 6 * 3600), "opened_at", "last_event_at")


def decisions(spark, d):
    return run(spark, d).decided.select(
        "event_id", "classification", "severity", "session_key", "incident_group_key", "is_new_session",
        "escalated", "session_was_notified", F.array_join("flags", ",").alias("flags"), "reason", "should_notify")


def decisions_long_sessions(spark, d):
    """Decisions where sessions last hours, so that most rows fold into one."""
    out = decide(classed(spark, d).withColumn("confidence", F.lit(0.9)), decision_time(), gap_s=6 * 3600)
    return out.select("event_id", "incident_group_key", "is_new_session", "session_was_notified", "reason")


def records(spark, d):
    out = run(spark, d).records
    return out.select(
        *[c for c in out.columns if c not in ("context", "suggested_actions", "triaged_at")],
        "context.*", F.array_join("suggested_actions", "|").alias("suggested_actions"),
        F.unix_micros("triaged_at").alias("triaged_at"))


def incidents(spark, d):
    return micros_of(run(spark, d).incidents, "opened_at", "last_event_at")


def notifications(spark, d):
    out = run(spark, d).notifications
    return out.withColumns({"suggested_actions": F.array_join("suggested_actions", "|"),
                            "flags": F.array_join("flags", ",")})


def outbox(spark, d):
    return notification_outbox(run(spark, d).notifications).select("incident_group_key", "channel", "payload")


def failed(spark, d):
    a = enriched(spark, d)
    out = dead_letters(resolve_attempts(varied_scorer(a)), F.col("timestamp"))
    return micros_of(out, "dead_lettered_at")


def attempts(spark, d):
    out = resolve_attempts(varied_scorer(enriched(spark, d)))
    return out.select("event_id", F.col("output").isNotNull().alias("answered"), "output.classification",
                      F.array_join("output.suggested_actions", "|").alias("suggested_actions"))


_RAW = """case event_id % 20
  when 0 then concat('{"classification":"alert","confidence":0.', cast(event_id % 10 as varchar(3)), ',"summary":"s","suggested_actions":["a"],"rationale":"r"}')
  when 1 then '{"classification":"noise","confidence":1,"summary":"","suggested_actions":[],"rationale":""}'
  when 2 then '{"classification":"suspicious","confidence":0.5,"summary":"s","suggested_actions":[],"rationale":"r"}'
  when 3 then '{"classification":"alert","confidence":1.01,"summary":"s","suggested_actions":[],"rationale":"r"}'
  when 4 then '{"classification":"alert","confidence":-0.1,"summary":"s","suggested_actions":[],"rationale":"r"}'
  when 5 then '{"classification":"alert","confidence":"0.5","summary":"s","suggested_actions":[],"rationale":"r"}'
  when 6 then '{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":[],"rationale":"r","extra":1}'
  when 7 then '{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":[]}'
  when 8 then concat('{"classification":"alert","confidence":0.5,"summary":"', repeat('s', 199 + cast(event_id % 3 as int)), '","suggested_actions":[],"rationale":"r"}')
  when 9 then concat('{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":["', repeat('a', 199 + cast(event_id % 3 as int)), '"],"rationale":"r"}')
  when 10 then concat('{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":["x"', repeat(',"x"', 8 + cast(event_id % 3 as int)), '],"rationale":"r"}')
  when 11 then concat('{"classification":"informational","confidence":0.5,"summary":"s","suggested_actions":[],"rationale":"', repeat('r', 499 + cast(event_id % 3 as int)), '"}')
  when 12 then concat('```json', '{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":[],"rationale":"r"}', '```')
  when 13 then '{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":"a","rationale":"r"}'
  when 14 then '{"classification":"alert","confidence":0.5,"summary":null,"suggested_actions":[],"rationale":"r"}'
  when 15 then '["alert"]'
  when 16 then '{"classification":"alert","confidence":0.5,"summary":"s","suggested_actions":[""],"rationale":"r"}'
  when 17 then '{"classification":"alert","confidence":true,"summary":"s","suggested_actions":[1],"rationale":"r"}'
  when 18 then concat('{"rationale":"', props_text, '","suggested_actions":["a","b"],"summary":"s","confidence":5e-1,"classification":"alert"}')
  else 'not json' end"""


def validate(spark, d):
    raw = table(spark, d, "events").selectExpr(
        "concat('e', cast(event_id as varchar(20))) as event_id", _RAW.replace("props_text", "event_type") + " as raw")
    return validate_output(raw, "raw").select(
        "event_id", (F.size("broken") == 0).alias("valid"), "output.classification", "output.confidence")


def notices(spark, d):
    out = run(spark, d).notices
    return out.groupBy("kind", "sensor", "severity", "reason", "retry_count", "detail").agg(
        F.count("*").alias("notices"), F.min(F.unix_micros("at")).alias("first_at"))


def coalesced(window_s, block_s):
    """Every alert as a notice of its kind."""
    def q(spark, d):
        a = alerts(spark, d).select(F.col("event_type").alias("reason"), "sensor", F.col("timestamp").alias("at"))
        fired, _ = coalesce_notices(a, window_s=window_s, block_s=block_s)
        return micros_of(fired, "fired_at")
    return q


def open_windows(spark, d):
    a = alerts(spark, d).select(F.col("event_type").alias("reason"), "sensor", F.col("timestamp").alias("at"))
    return micros_of(coalesce_notices(a, window_s=6 * 3600, block_s=86400)[1], "opened_at")


def health_outbox(spark, d):
    a = alerts(spark, d)
    dead = a.where("event_no % 19 = 0").select(
        F.col("source_alert_id").alias("alert_id"), "event_id", "source_module", "sensor", F.col("severity_hint").alias("severity"),
        F.lit("parse_failure").alias("reason"), (F.col("event_no") % 2 + 1).cast("int").alias("retry_count"),
        F.col("timestamp").alias("dead_lettered_at"),
        F.when(F.col("event_no") % 3 == 0, "").otherwise(F.concat(F.lit("ValidationError of "), "event_id")).alias("detail"))
    rows = degradation_notices(a.where("severity_hint = 'low' and event_no % 19 <> 0")).unionByName(
        age_notices(a.where("severity_hint <> 'low' and event_no % 19 <> 0"))).unionByName(dead_letter_notices(dead))
    return micros_of(notice_outbox(rows, window_s=3600), "fired_at").select(
        "reason", "sensor", "fired_at", "count", "channel", "payload")


def counters(spark, d):
    r = run(spark, d)
    return pipeline_counters(normalized(spark, d), r.answers, r.decided)


def retried(spark, d):
    """Answers that differ by attempt; only rows with an invalid one are asked again."""
    def ask(rows, attempt):  # the varied scorer writes a column ``attempts`` of its own
        answers = varied_scorer(rows.withColumnRenamed("attempts", "so_far"))
        return answers.withColumn("answer", F.get("attempts", F.lit(attempt - 1))).drop("attempts").withColumnRenamed("so_far", "attempts")

    out = resolve_attempts(retrying(ask)(enriched(spark, d)))
    return out.select("event_id", F.size("attempts").alias("attempts"), F.col("output").isNotNull().alias("answered"),
                      "output.classification")


def plugged(spark, d):
    """An enricher of one's own: its column reaches the decided rows."""
    def weekend(rows):
        return rows.withColumn("weekend", F.dayofweek("timestamp").isin(1, 7))

    return run(spark, d, enrichers=(weekend,)).decided.select("event_id", "weekend")


QUERIES = {
    "rubric_label": rubric,
    "rubric_scorer": rubric_answers,
    "sessions_rows": sessions(300),
    "sessions_rows_6h": sessions(6 * 3600),
    "session_windows": windows,
    "notify_decisions": decisions,
    "notify_decisions_6h": decisions_long_sessions,
    "triage_records": records,
    "incident_rollup": incidents,
    "notifications": notifications,
    "rendered_notifications": outbox,
    "resolve_attempts": attempts,
    "retried_attempts": retried,
    "own_enricher": plugged,
    "dead_letters": failed,
    "validate_outputs": validate,
    "system_notices": notices,
    "coalesced_notices": coalesced(60, 3600),
    "coalesced_notices_6h": coalesced(6 * 3600, 86400),
    "open_notice_windows": open_windows,
    "rendered_system_notices": health_outbox,
    "pipeline_counters": counters,
}

_CLASSED_SQL = f"""{ALERTS_SQL},
 classed as (select *, case when severity_hint in ('high', 'critical') then 2 when severity_hint = 'medium' then 1 else 0 end as cls_rank from keyed)"""


def _sessions(gap_s):
    return f"""with {_CLASSED_SQL},{sessions_sql(gap_s, 'classed')}
      select event_id, session_key, incident_group_key, session_seq = 1 as is_new_session,
        session_seq > 1 and cls_rank > opening_rank as escalated from sessions"""


def _coalesced(window_s, source="""select event_type as reason, sensor, us,
      row_number() over (partition by event_type, sensor order by us, event_no) as rn from alerts"""):
    return f"""n as ({source}),
     chain as (
      select reason, sensor, rn, us as start_us, cast(1 as bigint) as held, cast(1 as bigint) as fired, us as at_us from n where rn = 1
      union all
      select n.reason, n.sensor, n.rn,
        case when n.us - c.start_us >= {window_s}000000 then n.us else c.start_us end,
        case when n.us - c.start_us >= {window_s}000000 then 1 else c.held + 1 end,
        case when n.us - c.start_us >= {window_s}000000 then c.held end, n.us
      from chain c join n on n.reason = c.reason and n.sensor = c.sensor and n.rn = c.rn + 1)"""


_DETAIL = "ValidationError after 2 attempts: missing_key, confidence, summary, suggested_actions, rationale"
# Words and marks of the message layout.
_HEALTH_LINES = {
    "enrichment_degraded": ("⚑ enrichment degraded", "OpenSearch lookup failed — zeroed context enviado al modelo (in-distribution)."),
    "age_suppressed": ("⏳ age-suppressed", "Events older than notify_max_event_age were suppressed — still queryable in OpenSearch (ADR-0004 D-16)."),
}
_health_text = " ".join(
    f"when reason = '{k}' then concat('{head} · sensor ', sensor, ' · severity ', upper(severity), chr(10), '{body}', "
    "case when count > 1 then concat(chr(10), '×', cast(count as varchar), ' en la última ventana') else '' end)"
    for k, (head, body) in _HEALTH_LINES.items()) + (
    " else concat_ws(chr(10), concat('⚠️ unclassified (system) · ', reason, ' · sensor ', sensor, ' · severity ', upper(severity)), "
    "concat_ws('   ', case when event_no % 3 <> 0 then concat('detail: ValidationError of ', event_id) end, concat('retry_count: ', cast(event_no % 2 + 1 as varchar))), "
    "case when count > 1 then concat('×', cast(count as varchar), ' en la última ventana') end)")

# Words and marks of the message layout.
_RENDER = """concat_ws(chr(10),
   concat(case severity when 'critical' then '🔴' when 'high' then '🟠' when 'medium' then '🟡' else '⚪' end, ' ',
     upper(severity), ' · ', case classification when 'alert' then 'ALERT' when 'informational' then 'INFO' else 'noise' end,
     '   conf. ', printf('%.2f', cast(confidence as double))),
   case when all_flags <> '' then concat('⚑ ', replace(replace(all_flags, ',', ', '), '_', ' ')) end,
   {summary}, concat('Por qué: ', rationale), 'Evidencia (context):',
   concat('· IP vista antes (30d): ', case when src_ip_seen_before then 'sí' else 'no' end, '   · eventos 24h: ', related_events_24h),
   concat('· reglas distintas 24h: ', distinct_rules_from_src_24h, '   · últimos 10 min: ', events_last_10min),
   concat('· en allowlist: ', case when src_in_allowlist then 'sí' else 'no' end),
   'Acciones sugeridas (NO ejecutadas):',
   case event_no % 3 when 1 then concat('1. ', {actions}) when 2 then concat('1. ', replace({actions}, '|', chr(10) || '2. ')) end,
   concat('regla ', matched_rule, ' · src ', coalesce(replace(src_ip, '.', '[.]'), '—'), ' → dst ', replace(dst_ip, '.', '[.]')),
   concat('incidente ', incident_group_key, ' · sensor ', sensor))"""
_esc = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_plain = _RENDER.format(summary="answer_summary", actions="actions")
_marked = _RENDER.format(summary=_esc.format("answer_summary"), actions=_esc.format("actions"))
_ALL_FLAGS = "concat_ws(',', nullif(flags, ''), case when lookup_degraded then 'context_degraded' end)"
_CTX = ", ".join(CONTEXT.names)

ORACLES = {
    "rubric_label": f"with {SCORED_SQL} select event_id, label from ruled",
    "rubric_scorer": f"""with {SCORED_SQL} select event_id, coalesce(label, 'informational') as classification,
      case when label is null then 0.5 else 0.9 end as confidence, substr(summary, 1, 200) as summary from ruled""",
    "sessions_rows": _sessions(300),
    "sessions_rows_6h": _sessions(6 * 3600),
    "session_windows": f"""with {_CLASSED_SQL},{sessions_sql(6 * 3600, 'classed')}
      select session_key, incident_group_key, min(us) as opened_at, max(us) as last_event_at, count(*) as events
      from sessions group by session_key, incident_group_key, session_no""",
    "notify_decisions": f"""with {DECIDED_SQL}
      select event_id, classification, severity, session_key, incident_group_key, is_new_session, escalated,
        session_was_notified, flags, reason, {NOTIFIES} as should_notify from decided""",
    "notify_decisions_6h": f"""with {_CLASSED_SQL},{sessions_sql(6 * 3600, 'classed')},
      judged as (select *, event_no % 4 > 2 as aged, cls_rank = 2 as candidate from sessions),
      ranked as (select *, sum(case when candidate and not aged then 1 else 0 end) over (
        partition by signature_key, session_no order by us, event_no rows unbounded preceding) as hits from judged)
      select event_id, incident_group_key, session_seq = 1 as is_new_session,
        hits - case when candidate and not aged then 1 else 0 end > 0 as session_was_notified,
        case when aged then 'age_suppressed' when not candidate then 'not_candidate' when session_seq = 1 then 'new_session'
             when hits = 1 then 'intra_session_escalation' else 'suppressed' end as reason from ranked""",
    "triage_records": f"""with {DECIDED_SQL}
      select source_alert_id as alert_id, event_id, classification, confidence, severity, answer_summary as summary,
        incident_group_key, {_CTX}, actions as suggested_actions, rationale,
        us + event_no % 4 * 3600000000 as triaged_at from decided""",
    "incident_rollup": f"""with {DECIDED_SQL}
      select incident_group_key, min(us) as opened_at, max(us) as last_event_at, count(*) as events,
        case max(cls_rank) when 2 then 'alert' when 1 then 'informational' else 'noise' end as max_classification,
        bool_or({NOTIFIES}) as notified from decided group by incident_group_key""",
    "notifications": f"""with {DECIDED_SQL} select
        {', '.join({'summary': 'answer_summary as summary', 'suggested_actions': 'actions as suggested_actions', 'flags': _ALL_FLAGS + ' as flags'}.get(c, c) for c in NOTIFICATION.names)}
      from decided where {NOTIFIES}""",
    "rendered_notifications": f"""with {DECIDED_SQL}, sent as (select *, {_ALL_FLAGS} as all_flags from decided where {NOTIFIES})
      select incident_group_key, 'telegram' as channel, {_plain} as payload from sent
      union all
      select incident_group_key, 'slack', concat('{{"text":', cast(to_json({_marked}) as varchar), ',"mrkdwn":true}}') from sent""",
    "resolve_attempts": f"""with {SCORED_SQL} select event_id, true as answered, classification, actions as suggested_actions from scored
      union all select event_id, false, null, null from alerts where event_no % 19 = 0""",
    "retried_attempts": f"""with {SCORED_SQL} select event_id, case when event_no % 19 = 1 then 2 else 1 end as attempts, true as answered,
        classification from scored union all select event_id, 2, false, null from alerts where event_no % 19 = 0""",
    "own_enricher": f"""with {ALERTS_SQL} select event_id, dayofweek("timestamp") in (0, 6) as weekend from alerts where event_no % 19 <> 0""",
    "dead_letters": f"""with {ALERTS_SQL} select source_alert_id as alert_id, event_id, 'wazuh' as source_module, sensor,
        severity_hint as severity, 'parse_failure' as reason, 2 as retry_count, us as dead_lettered_at,
        '{_DETAIL}' as detail from alerts where event_no % 19 = 0""",
    "validate_outputs": f"""with r as (select concat('e', cast(event_id as varchar(20))) as event_id, {_RAW.replace('props_text', 'event_type')} as raw from events),
      p as (select *, case when json_valid(raw) then raw else 'null' end as j from r),
      v as (select event_id, j, json_type(j) = 'OBJECT'
        and list_sort(json_keys(j)) = ['classification', 'confidence', 'rationale', 'suggested_actions', 'summary']
        and json_type(j, '$.classification') = 'VARCHAR' and j ->> '$.classification' in ('noise', 'informational', 'alert')
        and json_type(j, '$.confidence') in ('DOUBLE', 'UBIGINT', 'BIGINT') and coalesce(try_cast(j ->> '$.confidence' as double) between 0 and 1, false)
        and json_type(j, '$.summary') = 'VARCHAR' and length(j ->> '$.summary') <= 200
        and json_type(j, '$.rationale') = 'VARCHAR' and length(j ->> '$.rationale') <= 500
        and json_type(j, '$.suggested_actions') = 'ARRAY' and json_array_length(j, '$.suggested_actions') <= 10
        and len(list_filter(json_type(j, '$.suggested_actions[*]'), lambda t: t <> 'VARCHAR')) = 0
        and len(list_filter(j ->> '$.suggested_actions[*]', lambda a: not length(a) between 1 and 200)) = 0 as ok from p)
      select event_id, coalesce(ok, false) as valid, case when ok then j ->> '$.classification' end as classification,
        case when ok then cast(j ->> '$.confidence' as double) end as confidence from v""",
    "system_notices": f"""with {DECIDED_SQL}, all_notices as (
        select 'dead_letter' as kind, sensor, severity_hint as severity, 'parse_failure' as reason, 2 as retry_count, '{_DETAIL}' as detail, us
        from alerts where event_no % 19 = 0
        union all select 'enrichment_degraded', sensor, severity_hint, 'enrichment_degraded', null, null, us from ctx where lookup_degraded
        union all select 'age_suppressed', sensor, severity_hint, 'age_suppressed', null, null, us from decided where reason = 'age_suppressed')
      select kind, sensor, severity, reason, retry_count, detail, count(*) as notices, min(us) as first_at
      from all_notices group by all""",
    "pipeline_counters": f"""with {DECIDED_SQL}, {_NORMAL_SQL}, c as (
        select 'soc_collector_published_total' as name, '' as label, '' as label_value from normal where violations = ''
        union all select 'soc_collector_quarantined_total', '', '' from normal where violations <> ''
        union all select 'soc_classify_total', 'outcome', case when event_no % 19 = 0 then 'parse_failure' else 'success' end from alerts
        union all select 'soc_events_processed_total', 'outcome', case when event_no % 19 = 0 then 'dead_letter' else 'success' end from alerts
        union all select 'soc_deadletter_total', 'reason', 'parse_failure' from alerts where event_no % 19 = 0
        union all select 'soc_enrichment_failures_total', '', '' from ctx where lookup_degraded
        union all select 'soc_group_total', 'action', case when is_new_session then 'new_session' else 'folded' end from decided
        union all select 'soc_notify_total', 'decision', case when {NOTIFIES} then 'notified' else 'suppressed' end from decided
        union all select 'soc_notify_age_suppressed_total', 'source_module', 'wazuh' from decided where reason = 'age_suppressed')
      select name, label, label_value, count(*) as count from c group by all""",
    "coalesced_notices": f"with recursive {ALERTS_SQL},{_coalesced(60)} select reason, sensor, at_us as fired_at, fired as count from chain where fired is not null",
    "coalesced_notices_6h": f"with recursive {ALERTS_SQL},{_coalesced(6 * 3600)} select reason, sensor, at_us as fired_at, fired as count from chain where fired is not null",
    "open_notice_windows": f"""with recursive {ALERTS_SQL},{_coalesced(6 * 3600)}
      select reason, sensor, max_by(start_us, rn) as opened_at, max_by(held, rn) as count from chain group by reason, sensor""",
    "rendered_system_notices": f"""with recursive {ALERTS_SQL},{_coalesced(3600, '''select
        case when event_no % 19 = 0 then 'parse_failure' when severity_hint = 'low' then 'enrichment_degraded' else 'age_suppressed' end as reason,
        sensor, us, severity_hint as severity, event_no, event_id,
        row_number() over (partition by event_no % 19 = 0, event_no % 19 <> 0 and severity_hint = 'low', sensor order by us, event_no) as rn from alerts''')},
      fired as (select c.reason, c.sensor, c.at_us as fired_at, c.fired as count, n.severity, n.event_no, n.event_id from chain c
        join n on n.reason = c.reason and n.sensor = c.sensor and n.rn = c.rn where c.fired is not null),
      said as (select *, case {_health_text} end as text from fired)
      select reason, sensor, fired_at, count, 'telegram' as channel, text as payload from said
      union all select reason, sensor, fired_at, count, 'slack', concat('{{"text":', cast(to_json(text) as varchar), ',"mrkdwn":true}}') from said""",
}
