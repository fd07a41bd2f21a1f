"""The alert views over the given event table, and helpers shared by the query files.

The same view text serves Spark and the SQL oracle; they differ in integer division only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.columns import source_key
from alertloom.operators.scoring import rubric_label


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_VIEW = """
  select
    concat('e', cast(event_id as varchar(20))) as event_id,
    event_id as event_no,
    {ts} as "timestamp",
    {us} as us,
    case when user_id % 5 = 0 then null
         else concat('10.0.', cast({hi} as varchar(20)), '.', cast(user_id % 250 as varchar(20))) end as src_ip,
    concat('192.0.2.', cast(event_id % 200 as varchar(20))) as dst_ip,
    concat('host-', cast(user_id % 7 as varchar(20))) as sensor,
    case when event_type = 'signup' then null else event_type end as rule_id,
    case event_type when 'view' then 'finding' when 'click' then 'NIDS' when 'purchase' then 'syscheck'
                    when 'error' then 'HIDS' else event_type end as event_type,
    case when event_type = 'error' then
      case event_id % 3 when 0 then 'sshd: authentication failed' when 1 then 'sshd: Accepted password'
                        else 'disk error' end end as signature,
    case when event_type = 'purchase' then
      case event_id % 4 when 0 then '/etc/passwd' when 1 then '/var/lib/dpkg/status'
                        when 2 then '/home/u/notes' end end as file_path,
    cast(least(floor(value / 10), 15) as int) as level,
    case when least(floor(value / 10), 15) >= 14 then 'critical' when least(floor(value / 10), 15) >= 10 then 'high'
         when least(floor(value / 10), 15) >= 5 then 'medium' else 'low' end as severity_hint,
    concat('a', cast(event_id % 700 as varchar(20))) as source_alert_id,
    concat(event_type, ' by user ', cast(user_id as varchar(20))) as summary,
    value
  from events
"""

ALERTS_SQL = "alerts as (" + _VIEW.format(
    ts="ts", us="epoch_us(ts)", hi="user_id // 250") + """),
 keyed as (select *, coalesce(nullif(rule_id, ''), nullif(signature, ''), event_type) as matched_rule,
             coalesce(src_ip, sensor) as source from alerts)"""


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alert view: unified event columns plus ``event_no``, ``us`` and ``value``."""
    text = _VIEW.format(ts="cast(ts as timestamp)", us="unix_micros(cast(ts as timestamp))", hi="user_id div 250")
    events = table(spark, sf_dir, "events")
    view = spark.sql(text.replace('"timestamp"', "`timestamp`").replace("from events", "from {events}"), events=events)
    return view.withColumns({
        "schema_version": F.lit("unified-event@1"), "source_module": F.lit("wazuh"),
        "raw_ref": F.concat(F.lit("table://events/"), "event_id"),
    })


def micros_of(df: DataFrame, *cols: str) -> DataFrame:
    """Timestamps as epoch microseconds, which compare alike in both engines."""
    return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in cols})


def joined_text(*cols: str):
    """Arrays as text, for comparison."""
    return {c: F.array_join(c, ",") for c in cols}


# Sliding history by correlated ranges over the two families of an event.
HISTORY_SQL = f"""{ALERTS_SQL},
 counted as (
  select *,
    count(*) over (partition by src_ip order by us range between 2592000000000 preceding and 1 preceding) as n30,
    count(*) filter (rule_id = matched_rule) over (partition by src_ip, matched_rule order by us range between 86400000000 preceding and 1 preceding) as src_rel,
    count(*) filter (rule_id = matched_rule) over (partition by sensor, matched_rule order by us range between 86400000000 preceding and 1 preceding) as host_rel,
    count(*) over (partition by src_ip order by us range between 600000000 preceding and 1 preceding) as src_burst,
    count(*) over (partition by sensor order by us range between 600000000 preceding and 1 preceding) as host_burst,
    count(distinct rule_id) over (partition by src_ip order by us range between 86400000000 preceding and 1 preceding) as src_rules,
    count(distinct rule_id) over (partition by sensor order by us range between 86400000000 preceding and 1 preceding) as host_rules,
    event_type = 'finding' and min(us) over (partition by source_alert_id) < us as finding_seen_before
  from keyed),
 history as (
  select * exclude (n30, src_rel, host_rel, src_burst, host_burst, src_rules, host_rules),
    src_ip is not null and n30 > 0 as src_ip_seen_before,
    case when src_ip is null then host_rel else src_rel end as related_events_24h,
    case when src_ip is null then host_rules else src_rules end as distinct_rules_from_src_24h,
    case when src_ip is null then host_burst else src_burst end as events_last_10min,
    source in ('10.0.0.7', '10.0.0.111', 'host-3') as src_in_allowlist
  from counted)"""

ALLOWLIST = " 10.0.0.7, 10.0.0.111,,host-3 "

# Some look-ups fail: their context is zeroed.  Class by rubric; undecided rows are informational
# at 0.5; some events never get a valid answer.
SCORED_SQL = f"""{HISTORY_SQL},
 ctx as (
  select * replace (
      src_ip_seen_before and event_no % 23 <> 0 as src_ip_seen_before,
      case when event_no % 23 = 0 then 0 else related_events_24h end as related_events_24h,
      case when event_no % 23 = 0 then 0 else distinct_rules_from_src_24h end as distinct_rules_from_src_24h,
      case when event_no % 23 = 0 then 0 else events_last_10min end as events_last_10min,
      src_in_allowlist and event_no % 23 <> 0 as src_in_allowlist,
      finding_seen_before and event_no % 23 <> 0 as finding_seen_before),
    event_no % 23 = 0 as lookup_degraded
  from history),
 ruled as (
  select *, case
    when event_type in ('syscheck', 'rootcheck', 'fim') then
      case when regexp_matches(coalesce(file_path, ''), '/etc/passwd|/etc/shadow|/etc/sudoers|sshd_config|crontab') then 'alert'
           when regexp_matches(coalesce(file_path, ''), '/var/lib/dpkg/|/var/cache/apt/') then 'noise'
           else 'informational' end
    when src_in_allowlist then 'informational'
    when event_type in ('NIDS', 'ids', 'suricata')
         and (events_last_10min >= 3 or related_events_24h >= 5 or distinct_rules_from_src_24h >= 2) then 'alert'
    when event_type in ('NIDS', 'ids', 'suricata') and not src_ip_seen_before and related_events_24h = 0 then 'noise'
    when regexp_matches(lower(coalesce(signature, rule_id, '')), 'auth|login|ssh|brute') then
      case when related_events_24h >= 4 then 'alert' else 'informational' end
    when contains(coalesce(signature, ''), '[neutralized]') then 'alert' end as label
  from ctx),
 scored as (
  select * exclude (finding_seen_before), coalesce(label, 'informational') as classification,
    case when label is null then 0.5 else 0.9 end as confidence,
    case coalesce(label, 'informational') when 'alert' then 2 when 'informational' then 1 else 0 end as cls_rank,
    'Seen <b>' || summary || '</b> & more' as answer_summary,
    case event_no % 3 when 0 then '' when 1 then 'Block ' || source else 'Check <host>|Rotate & report' end as actions,
    'related_events_24h=' || cast(related_events_24h as varchar) as rationale,
    -- an earlier event of the same alert, of any kind, got a record
    event_type = 'finding' and not lookup_degraded and exists (select 1 from keyed r where r.source_alert_id = ruled.source_alert_id
      and r.event_no % 19 <> 0 and r.event_id <> ruled.event_id and r.us < ruled.us) as finding_seen_before
  from ruled where event_no % 19 <> 0)"""


def varied_scorer(df: DataFrame) -> DataFrame:
    """Rubric classes with actions and markup; some first answers, and some whole rows, are invalid."""
    label = rubric_label()
    no = F.col("event_no")
    actions = F.when(no % 3 == 0, F.array().cast("array<string>")).when(
        no % 3 == 1, F.array(F.concat(F.lit("Block "), source_key()))).otherwise(
        F.array(F.lit("Check <host>"), F.lit("Rotate & report")))
    good = F.to_json(F.struct(
        F.coalesce(label, F.lit("informational")).alias("classification"),
        F.when(label.isNull(), 0.5).otherwise(0.9).alias("confidence"),
        F.concat(F.lit("Seen <b>"), "summary", F.lit("</b> & more")).alias("summary"),
        actions.alias("suggested_actions"),
        F.concat(F.lit("related_events_24h="), F.col("context.related_events_24h").cast("string")).alias("rationale")))
    bad = F.lit('{"classification":"alert"}')
    return df.withColumn("attempts", F.when(no % 19 == 0, F.array(F.lit("not json"), bad)).when(
        no % 19 == 1, F.array(bad, good)).otherwise(F.array(good)))


def sessions_sql(gap_s: int, source: str = "scored") -> str:
    """Sessions by gap, over a relation with the alert view's columns and cls_rank."""
    return f"""
 gaps as (select *, source || ':' || matched_rule as signature_key,
   us - lag(us) over (partition by source, matched_rule order by us, event_no) as gap from {source}),
 numbered as (select *, sum(case when gap is null or gap > {gap_s * 1_000_000} then 1 else 0 end)
   over (partition by signature_key order by us, event_no) as session_no from gaps),
 sessions as (select *,
   row_number() over s as session_seq, first_value(us) over s as first_us, first_value(cls_rank) over s as opening_rank,
   'session:' || sha256(signature_key) as session_key,
   sha1(signature_key || '|' || cast(first_value(us) over s // 1000000 as varchar)) as incident_group_key
  from numbered window s as (partition by signature_key, session_no order by us, event_no
    rows between unbounded preceding and unbounded following))"""


# Decision per row; "now" is the event time plus a few hours, so that some rows are too old.
AGE_HOURS = "(event_no % 4)"
DECIDED_SQL = f"""{SCORED_SQL},{sessions_sql(300)},
 judged as (select *, {AGE_HOURS} * 3600 > 7200 as aged,
   severity_hint in ('high', 'critical') as severe, confidence < 0.7 as unsure,
   severity_hint in ('high', 'critical') or confidence < 0.7 or classification = 'alert' as candidate from sessions),
 ranked as (select *, sum(case when candidate and not aged then 1 else 0 end) over (
   partition by signature_key, session_no order by us, event_no rows unbounded preceding) as hits from judged),
 decided as (select *, severity_hint as severity,
   session_seq = 1 as is_new_session, session_seq > 1 and cls_rank > opening_rank as escalated,
   hits - case when candidate and not aged then 1 else 0 end > 0 as session_was_notified,
   case when aged then 'age_suppressed' when not candidate then 'not_candidate'
        when session_seq = 1 then 'new_session' when hits = 1 then 'intra_session_escalation'
        else 'suppressed' end as reason,
   case when aged then '' else concat_ws(',',
     case when severe then 'severity_floor' end,
     case when severe and classification = 'noise' then 'false_positive_candidate' end,
     case when not severe and unsure then 'low_confidence' end) end as flags
  from ranked)"""
NOTIFIES = "reason in ('new_session', 'intra_session_escalation')"


def decision_time():
    return F.timestamp_micros(F.unix_micros("timestamp") + F.expr(AGE_HOURS) * 3_600_000_000)
