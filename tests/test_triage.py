"""History, sessions, decisions, coalescing: literal rows and sequential simulations."""

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from alertloom.operators.decide import decide
from alertloom.operators.history import enrich, history_counts, reaching_slots, slot_summary
from alertloom.operators.notices import coalesce_notices
from alertloom.operators.scoring import resolve_attempts, validate_output
from alertloom.operators.sessions import sessionize

T0 = datetime(2026, 1, 31, tzinfo=timezone.utc)
EVENT = "event_id string, timestamp timestamp, sensor string, src_ip string, rule_id string, signature string, event_type string, source_alert_id string"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT)


def brute_counts(rows, e):
    _, t, sensor, src, rule, sig, kind, _ = e
    wanted = rule or sig or kind
    mine = [r for r in rows if (r[3] == src if src else r[2] == sensor) and r[1] < t]

    def since(span):
        return [r for r in mine if r[1] >= t - span]

    day = since(timedelta(hours=24))
    return (bool(src) and bool(since(timedelta(days=30))), sum(r[4] == wanted for r in day),
            len({r[4] for r in day if r[4]}), len(since(timedelta(minutes=10))))


def test_history_edges_and_random_rows_against_brute_force(spark):
    us = timedelta(microseconds=1)
    spots = [T0, T0 - us, T0 - timedelta(minutes=10), T0 - timedelta(minutes=10) - us, T0 - timedelta(hours=24),
             T0 - timedelta(hours=24) - us, T0 - timedelta(days=30), T0 - timedelta(days=30) - us]
    rows = [(f"x{i}", t, "h1", "10.0.0.9", f"r{i % 3}", None, "NIDS", "a") for i, t in enumerate(spots)]
    rng = random.Random(7)
    for i in range(400):
        t = T0 + timedelta(seconds=rng.choice([rng.randrange(3600), rng.randrange(200000)]) // 30 * 30)
        rows.append((f"e{i}", t, f"h{rng.randrange(2)}", rng.choice([None, "10.0.0.1", "10.0.0.2"]),
                     rng.choice([None, "r1", "r2", "r3"]), rng.choice([None, "r1", "sig"]), "kind", f"a{rng.randrange(5)}"))
    ev = events(spark, rows)
    names = ["src_ip_seen_before", "related_events_24h", "distinct_rules_from_src_24h", "events_last_10min"]
    want = {r[0]: brute_counts(rows, r) for r in rows}
    for got in (history_counts(ev, ev), history_counts(ev, events(spark, rows)),
                history_counts(ev, events(spark, rows), past_slots=slot_summary(ev))):
        assert {r.event_id: tuple(r[n] for n in names) for r in got.collect()} == want


def test_hot_source_is_exact(spark):
    rows = [(f"e{i}", T0 + timedelta(seconds=i), "h", "10.0.0.1", f"r{i % 4}", None, "k", "a") for i in range(3000)]
    ev = events(spark, rows)
    got = {r.event_id: r for r in history_counts(ev, ev).collect()}
    last = got["e2999"]
    assert (last.events_last_10min, last.related_events_24h, last.distinct_rules_from_src_24h) == (600, 749, 4)


def test_far_slots_of_the_past_count_as_one_row_per_key(spark):
    rng = random.Random(5)
    rows = [(f"e{i}", T0 + timedelta(seconds=rng.randrange(45 * 86400)), f"h{rng.randrange(2)}", rng.choice([None, "10.0.0.1", "10.0.0.2"]),
             rng.choice([None, "r1", "r2", "r3"]), None, "x") for i in range(1500)]
    names = "event_id string, timestamp timestamp, sensor string, src_ip string, rule_id string, signature string, event_type string"
    history = spark.createDataFrame(rows, names).persist()
    lo = T0 + timedelta(days=30, seconds=4321)
    since = F.unix_micros(F.lit(lo))
    asking = history.where(F.col("timestamp") >= F.lit(lo))
    slots = slot_summary(history)
    near = reaching_slots(slots, since)
    got = history_counts(asking, history, past_slots=near, since=since)
    want = history_counts(history, history).where(F.col("timestamp") >= F.lit(lo))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert near.count() < slots.count() / 1.5
    assert near.where("rule is null and n = 0").count() == near.where("rule is null and n = 0").select("key").distinct().count() == 4


def test_notices_and_dead_letters_join_nothing(spark):
    from catalog.triage import run

    out = run(spark, "/root/testdata/sf0.001")
    for rows in (out.notices, out.dead_letters, out.answers):
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert out.answers.count() == out.resolved.count()


def test_findings_allowlist_and_degraded(spark):
    rows = [("e1", T0, "h1", None, None, None, "finding", "a1"), ("e2", T0 + timedelta(hours=40), "h1", None, None, None, "finding", "a1"),
            ("e3", T0 + timedelta(hours=50), "h2", None, None, None, "other", "a1")]
    ev = events(spark, rows)
    out = {r.event_id: r.context for r in enrich(ev, ev, allowlist=" h2 ,,x", degraded=F.col("event_id") == "e3").collect()}
    assert [out[e].finding_seen_before for e in ("e1", "e2", "e3")] == [False, True, False]
    assert out["e3"].lookup_degraded and not out["e3"].src_in_allowlist and out["e3"].matched_rule == "other"
    stored = spark.createDataFrame([("a1", "e1")], "alert_id string, event_id string")
    out = {r.event_id: r.context.finding_seen_before for r in enrich(ev.where("event_id = 'e1'"), ev, triaged=stored).collect()}
    assert out == {"e1": False}
    assert all(r.context.lookup_degraded for r in enrich(ev, None).collect())


def simulate(rows, gap, now, threshold=0.7, max_age=7200):
    """One event at a time, as a live worker would."""
    rank = {"noise": 0, "informational": 1, "alert": 2}
    open_, out = {}, {}
    for eid, ts, key, cls, conf, sev in sorted(rows, key=lambda r: (r[1], r[0])):
        s = open_.get(key)
        new = s is None or (ts - s["last"]).total_seconds() > gap
        if new:
            s = open_[key] = {"first": ts, "opening": cls, "notified": False}
        s["last"] = ts
        escalated = not new and rank[cls] > rank[s["opening"]]
        flags = []
        if (now - ts).total_seconds() > max_age:
            reason = "age_suppressed"
        else:
            candidate = True
            if sev in ("high", "critical"):
                flags = ["severity_floor"] + (["false_positive_candidate"] if cls == "noise" else [])
            elif conf < threshold:
                flags = ["low_confidence"]
            else:
                candidate = cls == "alert"
            reason = ("not_candidate" if not candidate else "new_session" if new
                      else "suppressed" if s["notified"] else "intra_session_escalation")
        if reason in ("new_session", "intra_session_escalation"):
            s["notified"] = True
        out[eid] = (new, escalated, reason, flags)
    return out


def decision_rows(rng, n):
    out = []
    for i in range(n):
        out.append((f"e{i:04d}", T0 + timedelta(seconds=rng.randrange(20000)), rng.choice(["10.0.0.1", "10.0.0.2"]),
                    rng.choice(["noise", "informational", "alert"]), rng.choice([0.69, 0.7, 0.9]), rng.choice(["low", "medium", "high"])))
    return out


def scored(spark, rows):
    df = spark.createDataFrame(rows, "event_id string, timestamp timestamp, src_ip string, classification string, confidence double, severity_hint string")
    return df.withColumns({"sensor": F.lit("h"), "rule_id": F.lit("r"), "signature": F.lit(None).cast("string"), "event_type": F.lit("k")})


def test_decisions_equal_a_sequential_worker(spark):
    rows = decision_rows(random.Random(3), 500)
    now = T0 + timedelta(seconds=20000)
    got = decide(scored(spark, rows), now, gap_s=60).collect()
    want = simulate([(r[0], r[1], r[2], r[3], r[4], r[5]) for r in rows], 60, now)
    assert {r.event_id: (r.is_new_session, r.escalated, r.reason, r.flags) for r in got} == want


def test_sessions_continue_over_batches(spark):
    from alertloom.plans.triage import Triage
    from alertloom.streaming.triage import TriageStream

    rows = sorted(decision_rows(random.Random(5), 300), key=lambda r: (r[1], r[0]))
    now = T0 + timedelta(seconds=20000)
    want = simulate(rows, 200, now)
    stream = TriageStream(spark, "unused", gap_s=200, lateness_s=100000)
    got, state = {}, None
    for part in (rows[:100], rows[100:200], rows[200:]):
        out = decide(scored(spark, part), now, gap_s=200, open_sessions=state)
        got.update({r.event_id: (r.is_new_session, r.escalated, r.reason, r.flags) for r in out.collect()})
        state = stream._open_sessions(Triage(None, out, now), state)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert got == want


def test_gap_of_exactly_the_limit_stays(spark):
    rows = [(f"e{i}", T0 + timedelta(seconds=s), "10.0.0.1", "noise", 0.9, "low") for i, s in enumerate((0, 300, 600, 901))]
    keys = [r.incident_group_key for r in sessionize(scored(spark, rows)).orderBy("event_id").collect()]
    assert keys[0] == keys[1] == keys[2] != keys[3]


def coalesce_simulated(rows, window):
    return coalesce_simulated_in_order(sorted(rows, key=lambda r: r[1]), window)


def coalesce_simulated_in_order(rows, window):
    state, fired = {}, []
    for key, t in rows:
        if key not in state:
            fired.append((key, t, 1))
            state[key] = [t, 1]
        elif t - state[key][0] >= window:
            fired.append((key, t, state[key][1]))
            state[key] = [t, 1]
        else:
            state[key][1] += 1
    return fired, state


def test_coalescing_equals_a_sequential_buffer(spark):
    rng = random.Random(11)
    rows = [("a", s) for s in (0, 1, 2, 3, 4, 65)]
    rows += [("dense", x / 7) for x in range(9000)]  # far more notices than windows, no pause
    rows += [(f"k{rng.randrange(4)}", rng.randrange(40000) / 3) for _ in range(1500)]
    rows += [("gaps", s) for s in (10, 7300, 7301, 20000, 20059, 20060)]
    exact = [(k, round(t * 1_000_000)) for k, t in rows]
    want, state = coalesce_simulated(exact, 60_000_000)

    def frame(part):
        df = spark.createDataFrame(part, "reason string, us long")
        return df.select("reason", F.lit("h").alias("sensor"), F.timestamp_micros("us").alias("at"))

    def told(df):
        return sorted((r.reason, r.us, r["count"]) for r in df.withColumn("us", F.unix_micros("fired_at")).collect())

    for block in (60, 300, 3600):
        fired, still_open = coalesce_notices(frame(exact), block_s=block)
        assert told(fired) == sorted(want)
        got = {r.reason: [r.us, r["count"]] for r in still_open.withColumn("us", F.unix_micros("opened_at")).collect()}
        assert got == state
    # In three batches, each going on from the windows left open.
    exact.sort(key=lambda r: r[1])
    open_windows, total = None, []
    late = exact[2990]  # comes again later: counts in the window open by then
    want, _ = coalesce_simulated_in_order(exact[:6000] + [late] + exact[6000:], 60_000_000)
    for part in (exact[:3000], exact[3000:6000], [late] + exact[6000:]):
        fired, left = coalesce_notices(frame(part), block_s=300, open_windows=open_windows)
        total += told(fired)
        open_windows = spark.createDataFrame(left.collect(), left.schema)
    assert sorted(total) == sorted(want)


GOOD = '{"classification":"alert","confidence":0.91,"summary":"s","suggested_actions":["a"],"rationale":"r"}'


def test_output_accept_and_reject_table(spark):
    cases = {
        GOOD: True, GOOD.replace("0.91", "1"): True, GOOD.replace('["a"]', "[]"): True, GOOD.replace("0.91", "1.01"): False,
        GOOD.replace("0.91", "-0.1"): False, GOOD.replace("0.91", '"0.9"'): False, GOOD.replace("0.91", "true"): False,
        GOOD.replace('"alert"', '"suspicious"'): False, GOOD.replace('"r"}', '"r","x":1}'): False, GOOD.replace(',"rationale":"r"', ""): False,
        GOOD.replace('["a"]', '["' + "a" * 201 + '"]'): False, GOOD.replace('["a"]', '[""]'): False, GOOD.replace('["a"]', '[1]'): False,
        GOOD.replace('["a"]', "[" + ",".join(['"a"'] * 11) + "]"): False, GOOD.replace('["a"]', '["a",null]'): False,
        "```json\n" + GOOD + "\n```": False, "[]": False, "": False, GOOD.replace('"s"', '"' + "s" * 201 + '"'): False,
        GOOD.replace('"s"', '"' + "é" * 200 + '"'): True, GOOD.replace('"s"', "null"): False,
    }
    df = spark.createDataFrame([(c,) for c in cases], "raw string")
    got = {r.raw: r.output is not None for r in validate_output(df, "raw").collect()}
    assert got == cases


def test_first_valid_attempt_wins(spark):
    rows = [("both", ["bad", "{}"]), ("second", ["bad", GOOD]), ("late", ["bad", "bad", GOOD]), ("none", [])]
    got = {r.event_id: r for r in resolve_attempts(spark.createDataFrame(rows, "event_id string, attempts array<string>")).collect()}
    assert got["second"].output.confidence == 0.91 and got["second"].failed_rules is None
    assert got["both"].output is None and "missing_key" in got["both"].failed_rules
    assert got["late"].output is None and got["none"].failed_rules == ["no_answer"]


def test_a_wrong_clock_closes_no_session(spark, tmp_path):
    from alertloom.operators.scoring import rubric_scorer
    from alertloom.streaming.triage import TriageStream

    def batch(part):
        return events(spark, part).withColumns({
            "severity_hint": F.lit("high"), "summary": F.lit("s"), "file_path": F.lit(None).cast("string"),
            "source_module": F.lit("m"), "dst_ip": F.lit(None).cast("string")})

    e0 = ("e0", T0, "h", "10.0.0.1", "r", None, "NIDS", "a0")
    e1 = ("e1", T0 + timedelta(seconds=60), "h", "10.0.0.1", "r", None, "NIDS", "a1")
    wrong = [(f"w{i}", T0 + timedelta(days=365 + i), "h", "10.0.0.9", "r", None, "NIDS", "aw") for i in range(2)]
    for name, parts in (("same", [[e0, wrong[0]], [e1]]), ("alone", [[e0], [wrong[0]], [e1, wrong[1]]])):
        stream = TriageStream(spark, str(tmp_path / name), scorer=rubric_scorer, now=T0)
        for n, part in enumerate(parts):
            stream.process(batch(part), n)
        decided = {r.event_id: r for r in stream.table("decided").collect()}
        assert decided["e0"].is_new_session and not decided["e1"].is_new_session
        assert decided["e1"].incident_group_key == decided["e0"].incident_group_key


def test_a_batch_writes_one_file_a_day_and_caches_no_shuffle(spark, tmp_path):
    from alertloom.streaming.triage import TriageStream

    rows = [(f"e{i}", T0 + timedelta(hours=2 * i), f"h{i % 5}", f"10.0.0.{i % 7}", "r", None, "NIDS", f"a{i}") for i in range(36)]
    part = events(spark, rows).withColumns({
        "severity_hint": F.lit("high"), "summary": F.lit("s"), "file_path": F.lit(None).cast("string"),
        "source_module": F.lit("m"), "dst_ip": F.lit(None).cast("string")})
    stream = TriageStream(spark, str(tmp_path / "days"), now=T0)
    stream.process(part, 0)
    assert stream.table("decided").count() == len(rows)
    for name in ("alerts", "slots"):
        days = [*(tmp_path / "days" / name / "batch_id=0").glob("event_date=*")]
        assert len(days) > 2 and all(len([*day.glob("*.parquet")]) == 1 for day in days)


def test_stream_replay_and_redelivery(spark, tmp_path):
    from alertloom.operators.scoring import rubric_scorer
    from alertloom.streaming.triage import TriageStream

    rows = [(f"e{i}", T0 + timedelta(seconds=40 * i), "h", "10.0.0.1", f"r{i % 2}", None, "NIDS", f"a{i % 3}") for i in range(24)]

    def batch(part):
        return events(spark, part).withColumns({
            "severity_hint": F.lit("high"), "summary": F.lit("s"), "file_path": F.lit(None).cast("string"),
            "source_module": F.lit("m"), "dst_ip": F.lit(None).cast("string")})

    def outcome(stream):
        return sorted((r.event_id, r.reason, r.incident_group_key, r.context) for r in stream.table("decided").collect())

    once = TriageStream(spark, str(tmp_path / "once"), scorer=rubric_scorer, now=T0)
    once.process(batch(rows), 0)
    parts = TriageStream(spark, str(tmp_path / "parts"), scorer=rubric_scorer, now=T0)
    parts.process(batch(rows[:10]), 0)
    parts.process(batch(rows[10:]), 1)
    parts.process(batch(rows[8:]), 1)  # the batch died and replays, with two events delivered again
    assert outcome(parts) == outcome(once)
    parts.process(batch(rows[:5]), 2)  # nothing new
    assert outcome(parts) == outcome(once)
    assert parts.table("records").count() == len(rows)
