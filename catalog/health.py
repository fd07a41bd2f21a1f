"""Queries over metric samples: histograms, quantiles, rates, alarms."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertloom.operators.alarms import (
    DISK_FULL, GPU_BUSY, GPU_MEMORY, INSTANCE_DOWN, Alarm, any_alarm, evaluate_alarm)
from alertloom.operators.metrics import (
    APPEND_EDGES, READ_EDGES, TRIAGE_EDGES, bucket_quantile, busy_percent, counter, counter_rate,
    latency_histogram, top_series)
from alertloom.streaming.windows import event_rate
from catalog.base import alerts, micros_of, table


def samples(spark, d):
    """Event values as latencies in seconds, and a counter that restarts now and then."""
    e = table(spark, d, "events")
    return e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type",
                    F.concat(F.lit("host-"), F.col("user_id") % 7).alias("instance"),
                    (F.col("value") / 16).alias("seconds"), "value",
                    (F.col("event_id") % 997).cast("double").alias("total"))


def histogram(edges, scale):
    def q(spark, d):
        s = samples(spark, d).withColumn("seconds", F.col("seconds") * scale)
        return latency_histogram(s, "seconds", ["event_type"], edges)
    return q


def quantiles(spark, d):
    b = latency_histogram(samples(spark, d), "seconds", ["event_type"])
    out = bucket_quantile(b, 0.5, ["event_type"]).unionByName(bucket_quantile(b, 0.95, ["event_type"]))
    return out.withColumn("value", F.round("value", 6))


def hourly_quantiles(spark, d):
    """p95 per five-minute bucket, as a dashboard panel asks for it."""
    s = samples(spark, d).withColumn("bucket_at", F.window("ts", "5 minutes")["start"])
    out = bucket_quantile(latency_histogram(s, "seconds", ["bucket_at"]), 0.95, ["bucket_at"])
    return micros_of(out, "bucket_at").withColumn("value", F.round("value", 6))


def rate(range_s, step_s=None, extrapolate=True):
    def q(spark, d):
        out = counter_rate(samples(spark, d), ["event_type"], value="total", range_s=range_s,
                           step_s=step_s, extrapolate=extrapolate)
        return micros_of(out, "at").withColumn("rate", F.round("rate", 9))
    return q


def rates_by_core(spark, d):
    return counter_rate(samples(spark, d), ["instance", "event_type"], value="total", range_s=86400)


def busy(spark, d):
    return micros_of(busy_percent(rates_by_core(spark, d)), "at").withColumn(
        "busy_percent", F.round("busy_percent", 6))


def top(spark, d):
    out = top_series(rates_by_core(spark, d).withColumn("rate", F.round("rate", 9)), ["instance", "event_type"], 8)
    return micros_of(out, "at")


_HIGH = Alarm("value-high", "value", "avg", ">=", 20, 2, "missing", 1800)
_PEAK = Alarm("value-peak", "value", "max", ">", 60, 2, "not_breaching", 1800)


def alarm(a):
    def q(spark, d):
        return micros_of(evaluate_alarm(samples(spark, d), a, ["event_type"]), "period_start").withColumn(
            "statistic", F.round("statistic", 6))
    return q


# The stock alarms over the samples, scaled so that each is crossed now and then.
_STOCK = [(INSTANCE_DOWN, "case when value > 20 then 1.0 else 0.0 end"), (DISK_FULL, "value * 4"), (GPU_BUSY, "value * 12"),
          (GPU_MEMORY, "value * 3000")]


def stock_states(spark, d):
    s = samples(spark, d)
    return [(a, evaluate_alarm(s.withColumn("value", F.expr(scaled).cast("double")), a, ["event_type"])) for a, scaled in _STOCK]


def stock(spark, d):
    states = [e.withColumn("name", F.lit(a.name)) for a, e in stock_states(spark, d)]
    return micros_of(reduce(DataFrame.unionByName, states), "period_start").withColumn("statistic", F.round("statistic", 4))


def stock_composite(spark, d):
    return micros_of(any_alarm([e for _, e in stock_states(spark, d)], ["event_type"]), "period_start")


def composite(spark, d):
    s = samples(spark, d)
    return micros_of(any_alarm([evaluate_alarm(s, a, ["event_type"]) for a in (_HIGH, _PEAK)], ["event_type"]), "period_start")


def windows(width, slide):
    def q(spark, d):
        out = event_rate(alerts(spark, d), ["event_type"], width, slide)
        return micros_of(out, "window_start", "window_end").withColumn("per_second", F.round("per_second", 9))
    return q


def counters(spark, d):
    return counter(alerts(spark, d), "soc_notify_age_suppressed_total", "source_module")


QUERIES = {
    "latency_histogram": histogram(TRIAGE_EDGES, 1.0),
    "append_histogram": histogram(APPEND_EDGES, 0.01),
    "read_histogram": histogram(READ_EDGES, 1.0),
    "bucket_quantile": quantiles,
    "bucket_quantile_5min": hourly_quantiles,
    "counter_rate": rate(86400),
    "counter_rate_sliding": rate(86400, 21600),
    "counter_rate_5min": rate(300),
    "counter_rate_plain": rate(86400, None, False),
    "busy_percent": busy,
    "top_series": top,
    "threshold_alarm": alarm(_HIGH),
    "peak_alarm": alarm(_PEAK),
    "composite_alarm": composite,
    "stock_alarms": stock,
    "stock_alarms_composite": stock_composite,
    "event_rate_5min": windows("5 minutes", None),
    "event_rate_sliding": windows("1 hour", "30 minutes"),
    "label_counter": counters,
}

_S = """s as (select epoch_us(ts) as us, event_type, 'host-' || cast(user_id % 7 as varchar) as instance,
   value / 16 as seconds, value, cast(event_id % 997 as double) as total from events)"""


def _hist(edges, scale, by="event_type", source="s"):
    rows = " union all ".join(
        f"select {by}, cast({e} as double) as le, count(*) filter (seconds * {scale} <= {e}) as bucket from {source} group by {by}" for e in edges)
    return rows + f" union all select {by}, cast('inf' as double), count(*) from {source} group by {by}"


def _quantile(q, by, rel):
    return f"""(select {by}, {q} as quantile, case when hit_le = cast('inf' as double) then low_le
        else low_le + (hit_le - low_le) * coalesce((r - low_n) / nullif(hit_n - low_n, 0), 0) end as value from (
      select {by}, r, min(le) filter (bucket >= r) as hit_le, arg_min(bucket, le) filter (bucket >= r) as hit_n,
        coalesce(max(le) filter (bucket < r), 0) as low_le, coalesce(max(bucket) filter (bucket < r), 0) as low_n
      from (select *, max(bucket) over (partition by {by}) * {q} as r from {rel}) group by {by}, r))"""


def _rate(by, range_s, step_s=None, extrapolate=True, source="s"):
    step, rng = (step_s or range_s) * 1_000_000, range_s * 1_000_000
    starts = f"unnest(range(us - us % {step} - {rng} + {step}, us - us % {step} + 1, {step}))"
    ext = f"inc * ((span + case when inc > 0 and v0 >= 0 and span * (v0 / inc) < ts0 then span * (v0 / inc) else ts0 end + te0) / span) / {float(range_s)}"
    return f"""placed as (select {by}, us, total, {starts} as w from {source}),
      inc as (select *, lag(total) over (partition by {by}, w order by us) as prev from placed where us >= w and us < w + {rng}),
      agg as (select {by}, w, sum(case when prev is null then 0 when total < prev then total else total - prev end) as inc, count(*) as n,
        min(us) as t0, max(us) as t1, arg_min(total, us) as v0 from inc group by {by}, w having count(*) > 1 and max(us) > min(us)),
      edges as (select *, (t1 - t0) / 1e6 as span, (t0 - w) / 1e6 as s0, (w + {rng} - t1) / 1e6 as e0, (t1 - t0) / 1e6 / (n - 1) as gap from agg),
      est as (select *, case when s0 >= gap * 1.1::double then gap / 2 else s0 end as ts0, case when e0 >= gap * 1.1::double then gap / 2 else e0 end as te0 from edges),
      rates as (select {by}, w + {rng} as "at", {ext if extrapolate else 'inc / span'} as rate from est)"""


def _alarm(a, name="a", source="s"):
    agg, cmp = a.statistic, a.comparison
    p = a.period_s * 1_000_000
    frame = (f"rows between {a.periods - 1} preceding and current row" if a.missing == "missing"
             else f"range between {a.periods - 1} preceding and current row")
    return f"""{name}_p as (select event_type, us - us % {p} as period_start, {agg}(value) as statistic, us // {p} as no from {source} group by event_type, us - us % {p}, us // {p}),
      {name} as (select event_type, period_start, statistic, statistic {cmp} {a.threshold} as breaching,
        min(case when statistic {cmp} {a.threshold} then 1 else 0 end) over w = 1 and count(*) over w = {a.periods} as in_alarm
        from {name}_p window w as (partition by event_type order by no {frame}))"""


def _windows(width_s, slide_s):
    w, sl = width_s * 1_000_000, slide_s * 1_000_000
    return f"""with p as (select event_type, unnest(range(us - us % {sl} - {w} + {sl}, us - us % {sl} + 1, {sl})) as start_us from (select epoch_us(ts) as us, * from events)),
      k as (select case event_type when 'view' then 'finding' when 'click' then 'NIDS' when 'purchase' then 'syscheck' when 'error' then 'HIDS' else event_type end as event_type, start_us from p)
      select start_us as window_start, start_us + {w} as window_end, event_type, count(*) as events, round(count(*) / {float(width_s)}, 9) as per_second from k group by start_us, event_type"""


def _stock_sql():
    parts = [f"s{i} as (select * replace (cast({scaled} as double) as value) from s), {_alarm(a, f'a{i}', f's{i}')}"
             for i, (a, scaled) in enumerate(_STOCK)]
    return f"with {_S}, " + ", ".join(parts)


ORACLES = {
    "latency_histogram": f"with {_S} {_hist(TRIAGE_EDGES, 1.0)}",
    "append_histogram": f"with {_S} {_hist(APPEND_EDGES, '0.01::double')}",
    "read_histogram": f"with {_S} {_hist(READ_EDGES, 1.0)}",
    "bucket_quantile": f"""with {_S}, h as ({_hist(TRIAGE_EDGES, 1.0)}), q as (select * from {_quantile('0.5::double', 'event_type', 'h')}
      union all select * from {_quantile('0.95::double', 'event_type', 'h')}) select event_type, quantile, round(value, 6) as value from q""",
    "bucket_quantile_5min": f"""with {_S}, b as (select *, us - us % 300000000 as bucket_at from s), h as ({_hist(TRIAGE_EDGES, 1.0, 'bucket_at', 'b')})
      select bucket_at, quantile, round(value, 6) as value from {_quantile('0.95::double', 'bucket_at', 'h')}""",
    "counter_rate": f'with {_S}, {_rate("event_type", 86400)} select event_type, "at", round(rate, 9) as rate from rates',
    "counter_rate_sliding": f'with {_S}, {_rate("event_type", 86400, 21600)} select event_type, "at", round(rate, 9) as rate from rates',
    "counter_rate_5min": f'with {_S}, {_rate("event_type", 300)} select event_type, "at", round(rate, 9) as rate from rates',
    "counter_rate_plain": f'with {_S}, {_rate("event_type", 86400, None, False)} select event_type, "at", round(rate, 9) as rate from rates',
    "busy_percent": f'with {_S}, {_rate("instance, event_type", 86400)} select instance, "at", round(100 - avg(rate) * 100, 6) as busy_percent from rates group by instance, "at"',
    "top_series": f"""with {_S}, {_rate("instance, event_type", 86400)}, r as (select instance, event_type, "at", round(rate, 9) as rate from rates)
      select * from (select "at", instance, event_type, rate, row_number() over (partition by "at" order by rate desc, instance, event_type) as rank from r) where rank <= 8""",
    "threshold_alarm": f"with {_S}, {_alarm(_HIGH)} select event_type, period_start, round(statistic, 6) as statistic, breaching, in_alarm from a",
    "peak_alarm": f"with {_S}, {_alarm(_PEAK)} select event_type, period_start, round(statistic, 6) as statistic, breaching, in_alarm from a",
    "stock_alarms": _stock_sql() + " " + " union all ".join(
        f"select event_type, period_start, round(statistic, 4) as statistic, breaching, in_alarm, '{a.name}' as name from a{i}"
        for i, (a, _) in enumerate(_STOCK)),
    "stock_alarms_composite": _stock_sql() + " select event_type, period_start, bool_or(in_alarm) as in_alarm from (" + " union all ".join(
        f"select event_type, period_start, in_alarm from a{i}" for i in range(len(_STOCK))) + ") group by all",
    "composite_alarm": f"""with {_S}, {_alarm(_HIGH, 'a')}, {_alarm(_PEAK, 'b')} select event_type, period_start, bool_or(in_alarm) as in_alarm
      from (select event_type, period_start, in_alarm from a union all select event_type, period_start, in_alarm from b) group by all""",
    "event_rate_5min": _windows(300, 300),
    "event_rate_sliding": _windows(3600, 1800),
    "label_counter": "select 'soc_notify_age_suppressed_total' as name, 'source_module' as label, 'wazuh' as label_value, count(*) as count from events",
}
