"""Queries over sinks, metric samples, sketches, split order and network context."""

from pyspark.sql import functions as F

from alertloom.operators.dataset import split_positions, stratified_split
from alertloom.operators.history import history_counts
from alertloom.operators.metrics import counter_rate
from alertloom.operators.networks import with_network
from alertloom.operators.scoring import dead_letters, resolve_attempts
from alertloom.operators.sketches import approx_distinct_24h
from alertloom.session import fresh_path, stage
from alertloom.sources.samples import read_samples, write_samples
from alertloom.sources.sinks import KeyedTable, append_dead_letters, persist_records, publish_events
from catalog.base import ALERTS_SQL, DECIDED_SQL, alerts, micros_of, table, varied_scorer
from catalog.dataset import pick
from catalog.health import _rate
from catalog.ingest import broken_events
from catalog.triage import _CLASSED_SQL, _DETAIL, classed, enriched, run


def published_twice(spark, d):
    """Events, some of them broken, published in parts that overlap, and all of them again."""
    path, bad = fresh_path(spark, "published"), fresh_path(spark, "unpublished")
    rows = broken_events(spark, d)
    part = F.pmod(F.crc32("event_id"), F.lit(3))
    for some in (rows.where(part < 2), rows.where(part > 0), rows):
        publish_events(some, path, bad)
    good = KeyedTable(path, day="timestamp").read(spark).select("event_id", F.lit("").alias("violations"))
    return good.unionByName(KeyedTable(bad, "message_sha256").read(spark).select(
        "event_id", F.array_join("violations", ",").alias("violations")))


def dead_letter_log(spark, d):
    path = fresh_path(spark, "dead-letters")
    out = stage(dead_letters(resolve_attempts(varied_scorer(enriched(spark, d))), F.col("timestamp")), "dead-letters-made")
    for some in (out.where("severity = 'low'"), out, out.where("severity <> 'low'")):
        append_dead_letters(some, path)
    return micros_of(KeyedTable(path).read(spark), "dead_lettered_at")


def persisted_twice(spark, d):
    path = fresh_path(spark, "records")
    records = run(spark, d).records
    for some in (records.where("severity <> 'low'"), records, records.where("classification = 'alert'")):
        persist_records(some, path)
    return KeyedTable(path).read(spark).select("event_id", "alert_id", "classification", "incident_group_key")


def sampled(spark, d):
    """Counters per event type and host, sampled with each event, some hours missing, starting again every 500 counts."""
    a = alerts(spark, d).where("hour(timestamp) not between 3 and 4")
    rows = a.select(
        F.col("timestamp").alias("ts"), F.lit("soc_events_processed_total").alias("name"),
        F.when(F.col("event_no") % 2 == 0, F.create_map(F.lit("outcome"), F.col("event_type"), F.lit("host"), F.col("sensor"))).otherwise(
            F.create_map(F.lit("host"), F.col("sensor"), F.lit("outcome"), F.col("event_type"))).alias("labels"),
        (F.col("event_no") % 500).cast("double").alias("value"))
    path = fresh_path(spark, "samples")
    write_samples(rows, path)
    return read_samples(spark, path, "soc_events_processed_total")


def sample_rates(spark, d):
    out = counter_rate(sampled(spark, d), ["series"], range_s=86400)
    return micros_of(out, "at").withColumn("rate", F.round("rate", 9))


def approx_distinct(spark, d):
    """Distinct destinations before each event: the exact number, and whether the sketches' estimate is within 2 %."""
    a = alerts(spark, d).withColumn("rule_id", F.col("dst_ip"))
    exact = history_counts(a, a).select("event_id", F.col("distinct_rules_from_src_24h").alias("exact"))
    return exact.join(approx_distinct_24h(a, a), "event_id").select(
        "event_id", "exact", (F.abs(F.col("approx_distinct") - F.col("exact")) <= 0.02 * F.col("exact")).alias("close"))


def split_order(spark, d):
    out = stratified_split(classed(spark, d), order=pick(), order_bound=2**32)
    return split_positions(out, seed=7).select("event_id", "split", "position")


def network_context(spark, d):
    """Networks over the source addresses, nested and listed twice, one per nation."""
    networks = table(spark, d, "nation").selectExpr(
        "concat('10.0.0.', n_nationkey * 10 % 256, '/', 22 + n_nationkey % 11) as cidr", "n_name as zone")
    return with_network(alerts(spark, d), networks).select("event_id", "src_ip", "network")


QUERIES = {
    "publish_twice": published_twice,
    "dead_letter_log": dead_letter_log,
    "persist_twice": persisted_twice,
    "sample_rates": sample_rates,
    "approx_distinct_24h": approx_distinct,
    "split_order": split_order,
    "network_context": network_context,
}

from catalog.ingest import ORACLES as INGEST_ORACLES  # noqa: E402
from catalog.dataset import ORACLES as DATASET_ORACLES  # noqa: E402

_SERIES = """'soc_events_processed_total{host="' || sensor || '",outcome="' || event_type || '"}'"""

ORACLES = {
    "publish_twice": INGEST_ORACLES["contract_violations"],
    "dead_letter_log": f"""with {ALERTS_SQL} select source_alert_id as alert_id, event_id, 'wazuh' as source_module, sensor,
        severity_hint as severity, 'parse_failure' as reason, 2 as retry_count, us as dead_lettered_at,
        '{_DETAIL}' as detail from alerts where event_no % 19 = 0""",
    "persist_twice": f"with {DECIDED_SQL} select event_id, source_alert_id as alert_id, classification, incident_group_key from decided",
    "sample_rates": f"""with {ALERTS_SQL}, s as (select us, {_SERIES} as series, cast(event_no % 500 as double) as total from alerts
        where hour("timestamp") not between 3 and 4), {_rate("series", 86400)}
      select series, "at", round(rate, 9) as rate from rates""",
    "approx_distinct_24h": f"""with {ALERTS_SQL} select event_id, case
        when src_ip is null then count(distinct dst_ip) over (partition by sensor order by us range between 86400000000 preceding and 1 preceding)
        else count(distinct dst_ip) over (partition by src_ip order by us range between 86400000000 preceding and 1 preceding) end as exact,
        true as close from alerts""",
    "split_order": f"""select event_id, split, row_number() over (partition by split order by sha256('7:' || event_id)) - 1 as position
      from ({DATASET_ORACLES['stratified_split']})""",
    "network_context": f"""with {ALERTS_SQL},
      nets as (select 167772160 + n_nationkey * 10 % 256 as base, 22 + n_nationkey % 11 as size, n_name from nation),
      hosts as (select distinct src_ip, (split_part(src_ip, '.', 1)::bigint << 24) + (split_part(src_ip, '.', 2)::bigint << 16)
        + (split_part(src_ip, '.', 3)::bigint << 8) + split_part(src_ip, '.', 4)::bigint as ip from alerts where src_ip is not null),
      hits as (select src_ip, n_name as network, row_number() over (partition by src_ip order by size desc, n_name) as rn
        from hosts join nets on ip >> (32 - size) = base >> (32 - size))
      select event_id, alerts.src_ip, network from alerts left join hits on hits.src_ip = alerts.src_ip and rn = 1""",
}
