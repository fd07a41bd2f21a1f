"""Queries over the sliding history, enrichment and look-ups."""

from pyspark.sql import functions as F

from alertloom.functions.columns import matched_rule, source_key
from alertloom.operators.history import (
    allowlisted, enrich, finding_recurrence, history_counts, slot_summary, zeroed_context)
from alertloom.schemas import CONTEXT
from catalog.base import ALERTS_SQL, ALLOWLIST, HISTORY_SQL, alerts, table

COUNTS = ["src_ip_seen_before", "related_events_24h", "distinct_rules_from_src_24h", "events_last_10min"]


def history(spark, d):
    a = alerts(spark, d)
    return history_counts(a, a).select("event_id", *COUNTS)


def one_count(name):
    def run(spark, d):
        a = alerts(spark, d)
        return history_counts(a, a).select("event_id", name)
    return run


def history_from_slots(spark, d):
    """Look-backs answered from a stored slot summary plus the raw rows."""
    a = alerts(spark, d)
    return history_counts(a, a, past_slots=slot_summary(a)).select("event_id", *COUNTS)


def findings(spark, d):
    return finding_recurrence(alerts(spark, d)).select("event_id", "finding_seen_before")


def findings_stored(spark, d):
    """Recurrence against a stored record table holding every event, not only findings."""
    a = alerts(spark, d)
    stored = a.select(F.col("source_alert_id").alias("alert_id"), "event_id")
    return finding_recurrence(a, stored).select("event_id", "finding_seen_before")


def allowlist_literal(spark, d):
    return allowlisted(alerts(spark, d), ALLOWLIST).select("event_id", "src_in_allowlist")


def allowlist_names(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.concat(F.lit("10.0.0."), F.col("s_suppkey").cast("string")).alias("name")).unionByName(
        table(spark, d, "region").select(F.concat(F.lit("host-"), F.col("r_regionkey").cast("string")).alias("name")))


def allowlist_table(spark, d):
    return allowlisted(alerts(spark, d), allowlist_names(spark, d)).select("event_id", "src_in_allowlist")


def allowlist_salted(spark, d):
    """The same look-up with the broadcast bound set to zero, so that it joins on salted keys."""
    return allowlisted(alerts(spark, d), allowlist_names(spark, d), max_broadcast_rows=0).select(
        "event_id", "src_in_allowlist")


def full_context(spark, d):
    a = alerts(spark, d)
    return enrich(a, a, allowlist=ALLOWLIST).select("event_id", "context.*")


def degraded_context(spark, d):
    """Look-ups fail for the alerts of one sensor."""
    a = alerts(spark, d)
    return enrich(a, a, allowlist=ALLOWLIST, degraded=F.col("sensor") == "host-2").select("event_id", "context.*")


def unavailable_context(spark, d):
    return enrich(alerts(spark, d), None).select("event_id", "context.*")


def keys(spark, d):
    a = alerts(spark, d)
    return a.select("event_id", matched_rule().alias("matched_rule"), source_key().alias("aggregation_key"),
                    F.col("src_ip").isNull().alias("host_event"))


QUERIES = {
    "history_counts": history,
    "history_30d_seen": one_count("src_ip_seen_before"),
    "related_24h": one_count("related_events_24h"),
    "burst_10min": one_count("events_last_10min"),
    "distinct_rules_24h": one_count("distinct_rules_from_src_24h"),
    "history_from_slots": history_from_slots,
    "finding_recurrence": findings,
    "finding_recurrence_stored": findings_stored,
    "allowlist": allowlist_literal,
    "allowlist_table": allowlist_table,
    "allowlist_salted": allowlist_salted,
    "full_context": full_context,
    "degraded_context": degraded_context,
    "unavailable_context": unavailable_context,
    "matched_rule": keys,
}

_names = ", ".join(CONTEXT.names)
_allow = f"""with {ALERTS_SQL}, names as (
  select concat('10.0.0.', cast(s_suppkey as varchar)) as name from supplier
  union select concat('host-', cast(r_regionkey as varchar)) from region)
 select event_id, source in (select name from names) as src_in_allowlist from keyed"""
_counts = f"with {HISTORY_SQL} select event_id, {', '.join(COUNTS)} from history"

ORACLES = {
    "history_counts": _counts,
    "history_from_slots": _counts,
    **{q: f"with {HISTORY_SQL} select event_id, {c} from history" for q, c in [
        ("history_30d_seen", "src_ip_seen_before"), ("related_24h", "related_events_24h"),
        ("burst_10min", "events_last_10min"), ("distinct_rules_24h", "distinct_rules_from_src_24h"),
        ("finding_recurrence", "finding_seen_before"), ("allowlist", "src_in_allowlist")]},
    "finding_recurrence_stored": f"""with {ALERTS_SQL}
      select a.event_id, a.event_type = 'finding' and exists (
        select 1 from alerts b where b.source_alert_id = a.source_alert_id and b.event_id <> a.event_id
      ) as finding_seen_before from alerts a""",
    "allowlist_table": _allow,
    "allowlist_salted": _allow,
    "full_context": f"with {HISTORY_SQL} select event_id, {_names.replace('lookup_degraded', 'false as lookup_degraded')} from history",
    "degraded_context": f"""with {HISTORY_SQL}, d as (select *, sensor = 'host-2' as lost from history)
      select event_id, src_ip_seen_before and not lost as src_ip_seen_before,
        case when lost then 0 else related_events_24h end as related_events_24h,
        case when lost then 0 else distinct_rules_from_src_24h end as distinct_rules_from_src_24h,
        case when lost then 0 else events_last_10min end as events_last_10min,
        src_in_allowlist and not lost as src_in_allowlist, finding_seen_before and not lost as finding_seen_before,
        matched_rule, lost as lookup_degraded from d""",
    "unavailable_context": f"""with {ALERTS_SQL}
      select event_id, false as src_ip_seen_before, cast(0 as bigint) as related_events_24h,
        cast(0 as bigint) as distinct_rules_from_src_24h, cast(0 as bigint) as events_last_10min,
        false as src_in_allowlist, false as finding_seen_before, matched_rule, true as lookup_degraded from keyed""",
    "matched_rule": f"""with {ALERTS_SQL}
      select event_id, matched_rule, source as aggregation_key, src_ip is null as host_event from keyed""",
}
