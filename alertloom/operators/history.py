"""Sliding-window history of every event: prior counts over 10 minutes, 24 hours and 30 days.

For an event at ``t`` a look-back of length ``span`` covers history in
``[t - span, t)``: the lower edge counts, the event's own instant does not.
Network events look back over their source address, host events (no source
address) over every alert of their sensor.

Plan shape.  One source may own a third of all alerts, so nothing is partitioned
by source alone.  Time is cut into slots of ten minutes (every span is a whole
number of slots) and rows are placed by (key, slot):

* a count over ``[t - span, t)`` is the sum of +1 at each history row and -1 at
  the row's time + span, taken over everything strictly before ``t``;
* inside a slot that sum is a running total over one sort;
* what earlier slots contribute comes from per-slot counts, which Spark
  pre-aggregates on the map side, and enters as one carry row per (key, slot);
* for distinct rules a slot only needs the first and last time of each rule.

The event rows are shuffled once, by (key, slot), and both running totals (per key
and per key and rule) use that same partitioning.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import MICROS, blank_to_null, cell_of, matched_rule, micros, source_key
from alertloom.schemas import require_columns

SLOT_S = 600
BURST_S = 600
DAY_S = 24 * 3600
SEEN_S = 30 * 24 * 3600

NEEDED = ["event_id", "timestamp", "sensor", "src_ip", "rule_id", "signature", "event_type"]


def _net_key(src: Column) -> Column:
    return F.concat(F.lit("n|"), src)


def _host_key(sensor: Column) -> Column:
    return F.concat(F.lit("h|"), sensor)


def _exploded(df: DataFrame, rows: list[Column], required: str, *keep: str) -> DataFrame:
    """Each input row as the non-null structs of ``rows``: one scan, several output rows.

    Null structs come out as rows without their ``required`` column and are filtered there:
    that compiles, where a lambda filter on the array would not.
    """
    return df.select(*keep, F.inline(F.array(*rows))).where(F.col(required).isNotNull())


def _history_rows(history: DataFrame, with_probes: bool) -> DataFrame:
    """The few columns of a history row that counting needs, plus the keys it counts under.

    ``own`` is the key an event looks back over; a network alert also counts under its
    sensor, for the host events there.
    """
    own = F.coalesce(_net_key(F.col("src_ip")), _host_key(F.col("sensor")))
    return history.select(
        own.alias("own"),
        F.when(F.col("src_ip").isNotNull(), _host_key(F.col("sensor"))).alias("other"),
        blank_to_null("rule_id").alias("rule"),
        matched_rule().alias("wanted"),
        micros("timestamp").alias("us"),
        *([F.struct(*[F.col(c) for c in history.columns]).alias("event")] if with_probes else []),
    )


def _slot_parts(rows: DataFrame, slot_us: int, counted: bool, probing: bool) -> DataFrame:
    """One-row slot summaries; ``counted`` rows are history, ``probing`` rows are events."""
    us = F.col("us")
    n, used = (F.lit(1), us) if counted else (F.lit(0), F.lit(None))

    def part(key: str, rule: str, n: Column, probes: int, used: Column) -> Column:
        return F.struct(
            F.col(key).alias("key"), F.col(rule).alias("rule"), n.cast("long").alias("n"),
            F.lit(probes).cast("long").alias("probes"),
            used.cast("long").alias("first_us"), used.cast("long").alias("last_us"))

    parts = []
    if counted:
        parts += [part("own", "rule", n, int(probing), used),
                  F.when(F.col("other").isNotNull(), part("other", "rule", n, 0, used))]
        if probing:  # the rule an event asks for is another one when it has no rule id
            parts.append(F.when(F.col("rule").isNull(), part("own", "wanted", F.lit(0), 1, F.lit(None))))
    else:
        parts.append(part("own", "wanted", n, 1, used))
    return _exploded(rows.withColumn("slot", cell_of(us, slot_us)), parts, "key", "slot")


def _fold_slots(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key", "rule", "slot").agg(
        F.sum("n").alias("n"), F.sum("probes").alias("probes"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"))


def slot_summary(history: DataFrame, slot_s: int = SLOT_S) -> DataFrame:
    """(key, rule, slot, n, first_us, last_us) of a stretch of history.

    Summaries of disjoint stretches add up, so a stream stores one per batch and never
    re-reads old alerts for its long look-backs.
    """
    rows = _history_rows(history, with_probes=False)
    return _fold_slots(_slot_parts(rows, slot_s * MICROS, counted=True, probing=False)).drop("probes")


# A row of the counting pass: what it adds to each count from ``us`` on.
_STEP = ("key", "rule", "us", "d_burst", "d_related", "d_rules", "seen_us")


def _step(key, us, rule=None, burst=0, related=0, rules=0, seen=None, **extra: Column) -> Column:
    def col(v, kind):
        return (F.lit(v) if v is None or isinstance(v, int) else v).cast(kind)

    values = (col(key, "string"), col(rule, "string"), col(us, "long"), col(burst, "long"),
              col(related, "long"), col(rules, "long"), col(seen, "long"))
    return F.struct(*[v.alias(n) for n, v in zip(_STEP, values)], *[c.alias(n) for n, c in extra.items()])


def _edge_steps(rows: DataFrame, counted: bool, probing: bool) -> DataFrame:
    """A history row enters both counts, leaves the ten-minute count, leaves the 24-hour count."""
    us, rule = F.col("us"), F.col("rule")
    event = {"event": F.col("event")} if probing else {}
    nothing = {"event": F.lit(None).cast(rows.schema["event"].dataType)} if probing else {}
    steps = []
    if probing and counted:
        # The event's own row asks under ``wanted``; it adds to that count only if that is its rule id.
        own_rule = F.when(rule.isNotNull(), 1).otherwise(0)
        steps.append(_step(F.col("own"), us, F.col("wanted"), 1, own_rule, 0, us, **event))
    elif probing:
        steps.append(_step(F.col("own"), us, F.col("wanted"), **event))
    elif counted:
        steps.append(_step(F.col("own"), us, rule, 1, 1, 0, us))
    if counted:
        other = F.col("other")
        later = us + BURST_S * MICROS, us + DAY_S * MICROS
        steps += [
            _step(F.col("own"), later[0], burst=-1, **nothing),
            F.when(rule.isNotNull(), _step(F.col("own"), later[1], rule, related=-1, **nothing)),
            F.when(other.isNotNull(), _step(other, us, rule, 1, 1, 0, us, **nothing)),
            F.when(other.isNotNull(), _step(other, later[0], burst=-1, **nothing)),
            F.when(other.isNotNull() & rule.isNotNull(), _step(other, later[1], rule, related=-1, **nothing)),
        ]
    return _exploded(rows, steps, "key")


def _carried_steps(slots: DataFrame, slot_us: int) -> DataFrame:
    """What earlier slots add to the slots that hold events, and when rules come and go.

    A rule is present at t iff some slot has ``first < t <= last + 24 h``; these
    intervals are cut at the rule's next row so that they never overlap.
    """
    day_slots, burst_slots = DAY_S * MICROS // slot_us, BURST_S * MICROS // slot_us
    by_rule = Window.partitionBy("key", "rule").orderBy("slot")
    next_first = F.expr("lead(first_us) ignore nulls over (partition by key, rule order by slot)")
    slots = slots.select(
        "*",
        F.sum("n").over(by_rule.rangeBetween(-day_slots, -1)).alias("d_related"),
        F.when(F.col("rule").isNotNull() & (F.col("n") > 0),
               F.least(next_first, F.col("last_us") + F.lit(DAY_S * MICROS))).alias("out_us"))

    # Totals of a key per slot, summed on the map side first: as many rows as there are slots, whatever the rules.
    def part(slot: Column, n: Column, probes: Column, last: Column, d: int) -> Column:
        return F.struct(slot.alias("slot"), n.cast("long").alias("n"), probes.cast("long").alias("probes"),
                        last.cast("long").alias("last_us"), F.lit(d).cast("long").alias("d"))

    present, none = F.col("out_us").isNotNull(), F.lit(None)
    coming = part(F.col("slot"), F.col("n"), F.col("probes"), F.col("last_us"), 1)
    staying = part(F.col("slot"), F.col("n"), F.col("probes"), F.col("last_us"), 0)
    leaving = part(cell_of(F.col("out_us"), slot_us), F.lit(0), F.lit(0), none, -1)
    totals = _exploded(slots, [F.when(present, coming).otherwise(staying), F.when(present, leaving)], "slot", "key").groupBy(
        "key", "slot").agg(F.sum("n").alias("n"), F.sum("d").alias("d"), F.max("last_us").alias("last_us"),
                           F.sum("probes").alias("probes"))
    by_slot = Window.partitionBy("key").orderBy("slot")
    before = by_slot.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        "key", "slot", "probes", F.sum("n").over(by_slot.rangeBetween(-burst_slots, -1)).alias("burst"),
        F.sum("d").over(before).alias("rules"), F.max("last_us").over(before).alias("seen")).where("probes > 0")
    start = F.col("slot") * slot_us - 1  # just before the slot: seen by all of its rows
    key = F.col("key")
    asked = (F.col("probes") > 0) & (F.col("d_related") > 0) & F.col("rule").isNotNull()
    of_rules = _exploded(slots, [
        F.when(present, F.struct(F.col("slot").alias("slot"), _step(key, F.col("first_us"), rules=1).alias("step"))),
        F.when(present, F.struct(cell_of(F.col("out_us"), slot_us).alias("slot"),
                                 _step(key, F.col("out_us"), rules=-1).alias("step"))),
        F.when(asked, F.struct(F.col("slot").alias("slot"),
                               _step(key, start, F.col("rule"), related=F.col("d_related")).alias("step"))),
    ], "step").select("step.*", "slot")
    of_key = carried.select(_step(key, start, burst=F.col("burst"), rules=F.col("rules"), seen=F.col("seen")).alias("step"), "slot")
    return of_rules.unionByName(of_key.select("step.*", "slot"))


def edge_slots(first_us: Column, last_us: Column, at: Column, slot_s: int = SLOT_S) -> Column:
    """Whether a history row at ``at`` lies in a slot whose rows events of [first, last] need singly.

    These are the slots a look-back can start or end in; all others count as a whole.
    """
    slot_us = slot_s * MICROS
    lo, hi, slot = (cell_of(c, slot_us) for c in (first_us, last_us, at))
    near = slot.between(lo - BURST_S // slot_s, hi)
    return near | slot.between(lo - DAY_S // slot_s, hi - DAY_S // slot_s)


def reaching_slots(slots: DataFrame, first_us: Column, slot_s: int = SLOT_S) -> DataFrame:
    """Slot summaries as far as events from ``first_us`` on need them.

    Behind the longest counted span only a key's last time is asked for: those slots become one row per key.  A rule
    that came and went before the first event's slot adds nothing to any count.
    """
    near = F.col("slot") >= cell_of(first_us, slot_s * MICROS) - DAY_S // slot_s
    far = slots.where(~near).groupBy("key").agg(F.max("last_us").alias("last_us")).select(
        "key", F.lit(None).cast("string").alias("rule"), cell_of(F.col("last_us"), slot_s * MICROS).alias("slot"),
        F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first_us"), "last_us")
    return slots.where(near).select(far.columns).unionByName(far)


def history_counts(events: DataFrame, history: DataFrame, slot_s: int = SLOT_S,
                   past_slots: DataFrame | None = None, since: Column | None = None) -> DataFrame:
    """Events plus src_ip_seen_before, related_events_24h, events_last_10min and
    distinct_rules_from_src_24h, all exact.

    ``history`` is the alert table.  It holds the events themselves too (an event never
    counts itself because its own instant is excluded); pass the same frame twice when
    it holds nothing else, which saves a scan.  With ``past_slots``, the slot summary of
    all of the history, ``history`` need only hold its ``edge_slots``.  ``since`` is a time (in
    microseconds) that no event lies before: what falls into slots before it is not shuffled.
    """
    if any(span % slot_s for span in (BURST_S, DAY_S, SEEN_S)):
        raise ValueError("slot_s must divide ten minutes")
    require_columns(events, NEEDED, "history_counts")
    slot_us = slot_s * MICROS
    itself = history is events
    asking = _history_rows(events, with_probes=True)
    past = asking if itself else _history_rows(history, with_probes=False)
    if past_slots is not None:
        parts = past_slots.withColumn("probes", F.lit(0).cast("long")).unionByName(
            _slot_parts(asking, slot_us, counted=False, probing=True))
    elif itself:
        parts = _slot_parts(asking, slot_us, counted=True, probing=True)
    else:
        parts = _slot_parts(past, slot_us, counted=True, probing=False).unionByName(
            _slot_parts(asking, slot_us, counted=False, probing=True))
    steps = _edge_steps(asking, counted=itself, probing=True)
    if not itself:
        steps = steps.unionByName(_edge_steps(past, counted=True, probing=False), allowMissingColumns=True)
    rows = (
        steps.withColumn("slot", cell_of(F.col("us"), slot_us))
        .unionByName(_carried_steps(_fold_slots(parts), slot_us), allowMissingColumns=True)
    )
    if since is not None:
        rows = rows.where(F.coalesce(F.col("slot") >= cell_of(since, slot_us), F.lit(True)))
    rows = rows.repartition("key", "slot")
    past_rows = Window.unboundedPreceding, -1
    of_key = Window.partitionBy("key", "slot").orderBy("us").rangeBetween(*past_rows)
    of_rule = Window.partitionBy("key", "slot", "rule").orderBy("us").rangeBetween(*past_rows)

    def total(col: str, w: Window) -> Column:
        return F.coalesce(F.sum(col).over(w), F.lit(0)).cast("long")

    is_net = F.col("event.src_ip").isNotNull()
    seen = F.max("seen_us").over(of_key) >= F.col("us") - F.lit(SEEN_S * MICROS)
    by_key = rows.select(
        "event", "key", "slot", "rule", "us", "d_related",
        (is_net & F.coalesce(seen, F.lit(False))).alias("src_ip_seen_before"),
        total("d_rules", of_key).alias("distinct_rules_from_src_24h"),
        total("d_burst", of_key).alias("events_last_10min"),
    )
    # Most steps are not about a rule's count: they have done their part and are not sorted again.
    by_rule = by_key.where(F.col("event").isNotNull() | (F.col("d_related") != 0)).select(
        "event", "src_ip_seen_before", total("d_related", of_rule).alias("related_events_24h"),
        "distinct_rules_from_src_24h", "events_last_10min")
    return by_rule.where(F.col("event").isNotNull()).select(
        "event.*", "src_ip_seen_before", "related_events_24h", "distinct_rules_from_src_24h", "events_last_10min")


SALTS = 32


def _salted(df: DataFrame, id_col: str = "event_id") -> DataFrame:
    return df.withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int"))


def _every_salt(df: DataFrame) -> DataFrame:
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def finding_recurrence(events: DataFrame, triaged: DataFrame | None = None,
                       among: DataFrame | None = None, split_s: int = DAY_S, within: bool = True) -> DataFrame:
    """Adds ``finding_seen_before``: a finding whose alert id was triaged for another event.

    Events see earlier ones among themselves, in (time, event_id) order, and any row of
    another event in ``triaged`` (alert_id, event_id).  Both look-ups are answered from a
    summary per alert id; the event side is spread over (alert id, day), or over salted
    copies, so a finding repeated without end does not land in one task.  ``among`` is
    the rows that count as triaged, ``events`` themselves by default.  With ``within=False`` only
    ``triaged`` counts.
    """
    us = micros("timestamp")
    spot = F.struct(us.alias("us"), F.col("event_id").alias("id"))
    day = cell_of(us, split_s * MICROS)
    joined, seen = events, F.lit(False)
    if within:
        among = events if among is None else among
        firsts = among.groupBy("source_alert_id", day.alias("_day")).agg(F.min(spot).alias("_spot"))
        # A day without a row among them looks back to the last day that has one.
        days = firsts.unionByName(events.select("source_alert_id", day.alias("_day")).distinct(), allowMissingColumns=True)
        upto = Window.partitionBy("source_alert_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
        firsts = days.groupBy("source_alert_id", "_day").agg(F.min("_spot").alias("_spot")).select(
            "source_alert_id", "_day", F.min("_spot").over(upto).alias("_first"))
        joined = events.withColumn("_day", day).join(firsts, ["source_alert_id", "_day"], "left")
        seen = F.coalesce(F.col("_first") < spot, F.lit(False))
    if triaged is not None:
        known = triaged.groupBy(F.col("alert_id").alias("source_alert_id")).agg(
            F.min("event_id").alias("_lo"), F.max("event_id").alias("_hi"))
        joined = _salted(joined).join(_every_salt(known), ["source_alert_id", "_salt"], "left")
        other = (F.col("_lo") != F.col("event_id")) | (F.col("_hi") != F.col("event_id"))
        seen = seen | F.coalesce(other, F.lit(False))
    is_finding = F.col("event_type") == "finding"
    return joined.select(*events.columns, (is_finding & seen).alias("finding_seen_before"))


BROADCAST_ROWS = 1_000_000


def allowlisted(events: DataFrame, allowlist: str | list[str] | DataFrame | None,
                max_broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Adds ``src_in_allowlist``: the event's source (or sensor) is a listed name.

    A comma-separated text or a list becomes a literal set.  A table is broadcast when
    it has at most ``max_broadcast_rows`` names, else joined on salted keys.
    """
    key = source_key()
    if allowlist is None:
        return events.withColumn("src_in_allowlist", F.lit(False))
    if isinstance(allowlist, str):
        allowlist = allowlist.split(",")
    if isinstance(allowlist, list):
        names = [n.strip() for n in allowlist if n.strip()]
        return events.withColumn("src_in_allowlist", F.coalesce(key.isin(names), F.lit(False)))
    names = allowlist.select(F.trim(allowlist.columns[0]).alias("_key")).where("_key <> ''").distinct()
    hit = F.col("_hit").isNotNull().alias("src_in_allowlist")
    if names.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows:
        side = F.broadcast(names.withColumn("_hit", F.lit(True)))
        return events.withColumn("_key", key).join(side, "_key", "left").select(*events.columns, hit)
    side = _every_salt(names.withColumn("_hit", F.lit(True)))
    return _salted(events.withColumn("_key", key)).join(side, ["_key", "_salt"], "left").select(
        *events.columns, hit)


def context_struct(degraded: Column | None = None) -> Column:
    """The eight context columns; zeroed and flagged where ``degraded`` holds."""
    lost = F.lit(False) if degraded is None else F.coalesce(degraded, F.lit(False))

    def flag(c: str) -> Column:
        return F.col(c) & ~lost

    def count(c: str) -> Column:
        return F.when(lost, F.lit(0)).otherwise(F.col(c)).cast("long")

    return F.struct(
        flag("src_ip_seen_before").alias("src_ip_seen_before"),
        count("related_events_24h").alias("related_events_24h"),
        count("distinct_rules_from_src_24h").alias("distinct_rules_from_src_24h"),
        count("events_last_10min").alias("events_last_10min"),
        flag("src_in_allowlist").alias("src_in_allowlist"),
        flag("finding_seen_before").alias("finding_seen_before"),
        matched_rule().alias("matched_rule"),
        lost.alias("lookup_degraded"),
    )


def zeroed_context(rule: Column | None = None) -> Column:
    """Context of an event whose look-ups failed."""
    no, none = F.lit(False), F.lit(0).cast("long")
    return F.struct(
        no.alias("src_ip_seen_before"), none.alias("related_events_24h"),
        none.alias("distinct_rules_from_src_24h"), none.alias("events_last_10min"),
        no.alias("src_in_allowlist"), no.alias("finding_seen_before"),
        (matched_rule() if rule is None else rule).alias("matched_rule"),
        F.lit(True).alias("lookup_degraded"),
    )


def with_batch_findings(resolved: DataFrame) -> DataFrame:
    """Resolved rows whose ``context.finding_seen_before`` also counts earlier rows of the same run.

    Only rows with a valid answer count: the others are dead letters and leave no record.
    """
    is_finding = F.coalesce(F.col("event_type") == "finding", F.lit(False))
    ok = resolved.where("output is not null")
    seen = finding_recurrence(resolved.where(is_finding), among=ok)
    own = F.col("context.finding_seen_before") | (F.col("finding_seen_before") & ~F.col("context.lookup_degraded"))
    judged = seen.withColumn("context", F.col("context").withField("finding_seen_before", own)).select(*resolved.columns)
    return judged.unionByName(resolved.where(~is_finding))


def enrich(events: DataFrame, history: DataFrame | None, triaged: DataFrame | None = None,
           allowlist: str | list[str] | DataFrame | None = None,
           degraded: Column | None = None, past_slots: DataFrame | None = None, within: bool = True,
           since: Column | None = None) -> DataFrame:
    """Events plus ``context``.  ``history=None`` means the look-ups are unavailable.

    ``degraded`` marks single events whose look-ups failed.  Events of one call count as
    triaged for the findings after them unless ``within`` is false.
    """
    if history is None:
        return events.withColumn("context", zeroed_context())
    out = history_counts(events, history, past_slots=past_slots, since=since)
    out = finding_recurrence(out, triaged, among=events, within=within)
    out = allowlisted(out, allowlist)
    return out.withColumn("context", context_struct(degraded)).select(*events.columns, "context")
