"""Pipeline counters, latency histograms, rates and quantiles over metric samples."""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import micros

# Every metric and the label names it may carry.
METRIC_LABELS = {
    "soc_enrichment_failures_total": (),
    "soc_deadletter_total": ("reason",),
    "soc_events_processed_total": ("outcome",),
    "soc_triage_duration_seconds": (),
    "soc_collector_published_total": (),
    "soc_collector_quarantined_total": (),
    "soc_classify_total": ("outcome",),
    "soc_notify_total": ("decision",),
    "soc_notify_age_suppressed_total": ("source_module",),
    "soc_group_total": ("action",),
    "soc_bus_acl_rejections_total": (),
    "soc_bus_xadd_duration_seconds": (),
    "soc_bus_xreadgroup_duration_seconds": (),
}

# Histogram edges in seconds.
TRIAGE_EDGES = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0, 30.0)
APPEND_EDGES = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5)
READ_EDGES = (0.1, 1.0, 5.0, 10.0, 20.0, 30.0)


def check_labels(name: str, labels: tuple[str, ...]) -> None:
    """Metrics carry closed label sets only, never alert content."""
    if name not in METRIC_LABELS:
        raise ValueError(f"unknown metric {name!r}")
    if set(labels) != set(METRIC_LABELS[name]):
        raise ValueError(f"{name} takes labels {METRIC_LABELS[name]}, got {labels}")


def counter(df: DataFrame, name: str, label: str | None = None, value: Column | None = None) -> DataFrame:
    """(name, label, label_value, count): rows of ``df`` per label value."""
    check_labels(name, (label,) if label else ())
    text = (F.lit("") if label is None else value if value is not None else F.col(label)).cast("string")
    counted = df.groupBy(text.alias("label_value")).agg(F.count("*").alias("count"))
    return counted.select(F.lit(name).alias("name"), F.lit(label or "").alias("label"), "label_value", "count")


def _tally(df: DataFrame, *counted: tuple[str, str | None, Column]) -> DataFrame:
    """Several counters of one frame in one pass: (name, label, the label's value or null where a row does not count)."""
    for name, label, _ in counted:
        check_labels(name, (label,) if label else ())
    rows = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(label or "").alias("label"), value.cast("string").alias("label_value"))
        for name, label, value in counted])
    return df.select(F.inline(rows)).where("label_value is not null").groupBy("name", "label", "label_value").agg(
        F.count("*").alias("count"))


def pipeline_counters(normalized: DataFrame, resolved: DataFrame, decided: DataFrame) -> DataFrame:
    """All counters of one run, from the normalizer's, resolver's and decision frames, each read once."""
    def where(condition: Column, value: str = "") -> Column:
        return F.when(condition, F.lit(value))

    ok, valid = F.size("violations") == 0, F.col("output").isNotNull()
    return reduce(DataFrame.unionByName, [
        _tally(normalized, ("soc_collector_published_total", None, where(ok)),
               ("soc_collector_quarantined_total", None, where(~ok))),
        _tally(resolved,
               ("soc_classify_total", "outcome", where(valid, "success").otherwise("parse_failure")),
               ("soc_events_processed_total", "outcome", where(valid, "success").otherwise("dead_letter")),
               ("soc_deadletter_total", "reason", where(~valid, "parse_failure")),
               ("soc_enrichment_failures_total", None, where(F.col("context.lookup_degraded")))),
        _tally(decided,
               ("soc_group_total", "action", where(F.col("is_new_session"), "new_session").otherwise("folded")),
               ("soc_notify_total", "decision", where(F.col("should_notify"), "notified").otherwise("suppressed")),
               ("soc_notify_age_suppressed_total", "source_module",
                F.when(F.col("reason") == "age_suppressed", F.col("source_module")))),
    ])


def latency_histogram(df: DataFrame, value: str, by: list[str] = (), edges: tuple[float, ...] = TRIAGE_EDGES) -> DataFrame:
    """(by..., le, bucket): cumulative counts per upper edge; the last edge is infinity.

    One pass: every edge is a conditional count in the same aggregate.
    """
    bounds = [*edges, float("inf")]
    # NaN sorts above every number in Spark but belongs to the infinite bucket only.
    counts = [F.count_if(F.col(value) <= e) for e in edges] + [F.count(value)]
    wide = df.groupBy(*by).agg(*[c.alias(f"_b{i}") for i, c in enumerate(counts)])
    rows = F.array(*[F.struct(F.lit(b).alias("le"), F.col(f"_b{i}").alias("bucket")) for i, b in enumerate(bounds)])
    return wide.select(*by, F.inline(rows))


def bucket_quantile(buckets: DataFrame, q: float, by: list[str] = (), le: str = "le", bucket: str = "bucket") -> DataFrame:
    """(by..., quantile, value) from cumulative buckets, linear inside the bucket.

    The lowest bucket starts at 0; a rank in the infinite bucket gives the highest finite
    edge; no observations give NaN.
    """
    edges = F.array_sort(F.collect_list(F.struct(F.col(le).alias("le"), F.col(bucket).cast("double").alias("n"))))
    g = buckets.groupBy(*by).agg(edges.alias("_e"))  # one entry per edge, a fixed small list
    g = g.withColumn("_rank", F.element_at("_e", -1)["n"] * F.lit(q))
    inside = F.filter("_e", lambda e: e["n"] >= F.col("_rank"))[0]
    below = F.element_at(F.filter(
        F.concat(F.array(F.struct(F.lit(0.0).alias("le"), F.lit(0.0).alias("n"))), F.col("_e")),
        lambda e: e["le"] < F.col("_hit.le")), -1)
    g = g.withColumn("_hit", inside).withColumn("_low", below)
    part = (F.col("_rank") - F.col("_low.n")) / F.nullif(F.col("_hit.n") - F.col("_low.n"), F.lit(0.0))
    value = (
        F.when(F.element_at("_e", -1)["n"] == 0, F.lit(float("nan")))
        .when(F.col("_hit.le") == float("inf"), F.col("_low.le"))
        .otherwise(F.col("_low.le") + (F.col("_hit.le") - F.col("_low.le")) * F.coalesce(part, F.lit(0.0)))
    )
    return g.select(*by, F.lit(q).alias("quantile"), value.alias("value"))


def counter_rate(samples: DataFrame, by: list[str], ts: str = "ts", value: str = "value",
                 range_s: int = 300, step_s: int | None = None, extrapolate: bool = True) -> DataFrame:
    """(by..., at, rate): per-second increase of a counter over the ``range_s`` before ``at``.

    A drop between neighbours is a reset: the counter restarted from zero.  At least two
    samples are needed.  ``extrapolate`` stretches the increase to the range's edges the
    way the dashboards' query language does: up to an edge that is within 1.1 average
    sample distances, else by half a distance, and never below a counter of zero.

    Samples are placed by (series, range), so a long or busy series is split over time.
    """
    step = step_s or range_s
    rng = F.window(F.col(ts).cast("timestamp"), f"{range_s} seconds", f"{step} seconds")
    placed = samples.select(*by, F.col(value).cast("double").alias("_v"), micros(ts).alias("_us"), rng.alias("_w"))
    order = Window.partitionBy(*by, "_w").orderBy("_us")
    prev = F.lag("_v").over(order)
    steps = placed.withColumn("_inc", F.when(prev.isNull(), 0.0).when(F.col("_v") < prev, F.col("_v"))
                              .otherwise(F.col("_v") - prev))
    g = steps.groupBy(*by, "_w").agg(
        F.sum("_inc").alias("_inc"), F.count("*").alias("_n"), F.min("_us").alias("_t0"),
        F.max("_us").alias("_t1"), F.min_by("_v", "_us").alias("_v0")).where("_n > 1")
    span = (F.col("_t1") - F.col("_t0")) / 1e6
    if extrapolate:
        gap = span / (F.col("_n") - 1)
        to_start = (F.col("_t0") - micros("_w.start")) / 1e6
        to_end = (micros("_w.end") - F.col("_t1")) / 1e6
        to_start = F.when(to_start >= gap * 1.1, gap / 2).otherwise(to_start)
        to_zero = span * (F.col("_v0") / F.col("_inc"))
        to_start = F.when((F.col("_inc") > 0) & (F.col("_v0") >= 0) & (to_zero < to_start), to_zero).otherwise(to_start)
        to_end = F.when(to_end >= gap * 1.1, gap / 2).otherwise(to_end)
        rate = F.col("_inc") * ((span + to_start + to_end) / span) / float(range_s)
    else:
        rate = F.col("_inc") / span
    return g.where("_t1 > _t0").select(*by, F.col("_w.end").alias("at"), rate.alias("rate"))


def busy_percent(idle_rates: DataFrame, instance: str = "instance", at: str = "at", rate: str = "rate") -> DataFrame:
    """(instance, at, busy_percent): 100 minus the mean idle rate of an instance's cores."""
    return idle_rates.groupBy(instance, at).agg((100 - F.avg(rate) * 100).alias("busy_percent"))


def top_series(rates: DataFrame, by: list[str], k: int = 8, at: str = "at", rate: str = "rate") -> DataFrame:
    """The ``k`` highest series at every evaluation time; ties go to the lower names."""
    order = Window.partitionBy(at).orderBy(F.desc(rate), *by)
    ranked = rates.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select(at, *by, rate, "rank")
