import ipaddress
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from alertloom.operators.dataset import split_positions
from alertloom.operators.networks import address_bits, with_network
from alertloom.operators.notices import coalesce_notices
from alertloom.operators.sketches import approx_distinct_24h, slot_sketches
from alertloom.session import fresh_path, written
from alertloom.sources.samples import counter_samples, progress_samples, read_samples, write_samples
from alertloom.sources.sinks import KeyedTable
from alertloom.streaming.ingest import batch_dir, dedupe_stream
from alertloom.streaming.late import LateSplit, late_counts
from alertloom.streaming import triage as stream_triage

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def test_keyed_table_reads_a_fraction_of_its_files(spark):
    table = KeyedTable(fresh_path(spark, "keyed"))
    rows = spark.range(4000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.col("id").alias("n"))
    table.append(rows.where("n < 3000"))
    table.append(rows.where("n >= 2000"))
    table.append(rows.where("n % 7 = 0"))
    got = table.read(spark)
    assert got.count() == got.select("event_id").distinct().count() == 4000
    all_files = set(spark.read.parquet(table.path).inputFiles())
    few = table.stored(rows.where("n in (5, 77)"))
    plan = few._jdf.queryExecution().executedPlan()
    assert len(plan.executeCollect()) == 2
    opened = plan.collectLeaves().apply(0).metrics().apply("numFiles").value()
    assert 0 < opened < len(all_files) / 10 and "EqualTo(event_id,e5)" in plan.toString()
    table.append(rows.limit(0))
    assert table.read(spark).count() == 4000
    assert KeyedTable(fresh_path(spark, "none")).stored(rows) is None


def test_networks_against_the_address_library(spark):
    rnd = random.Random(3)
    v4 = [f"10.{rnd.randrange(3)}.{rnd.randrange(4)}.{rnd.randrange(256)}" for _ in range(200)]
    v6 = [str(ipaddress.ip_address((0x20010DB8 << 96) + rnd.getrandbits(rnd.choice([4, 20, 70, 96])))) for _ in range(100)]
    nets = [(f"{rnd.choice(v4)}/{rnd.choice([0, 8, 14, 16, 23, 24, 30, 32])}", f"z{i}") for i in range(40)]
    nets += [(f"{rnd.choice(v6)}/{rnd.choice([0, 32, 48, 64, 100, 128])}", f"y{i}") for i in range(30)]
    parsed = [(ipaddress.ip_network(c, strict=False), z) for c, z in nets]
    bad = [("10.0.0.0/33", "bad"), ("10.0.0/8", "bad"), ("x", "bad"), (None, "bad"), ("10.0.0.0/8/9", "bad"), ("::/129", "bad"), ("10.0.0.0/-1", "bad")]
    odd = [None, "", "999.1.1.1", "::g", "2001:DB8::5", "::ffff:10.0.0.1", "fe80::1%eth0"]
    hot = [v4[0]] * 500
    events = spark.createDataFrame([(i, a) for i, a in enumerate(v4 + v6 + odd + hot)], "n int, src_ip string").withColumn("prefix", F.lit("own"))
    got = {r.n: r.network for r in with_network(events, spark.createDataFrame(nets + bad, "cidr string, zone string")).collect()}
    assert len(got) == 300 + len(odd) + 500
    for n, a in enumerate(v4 + v6 + odd + hot):
        try:
            ip = ipaddress.ip_address(a.split("%")[0]) if a else None
        except ValueError:
            ip = None
        hits = [(-net.prefixlen, z) for net, z in parsed if ip is not None and net.version == ip.version and ip in net]
        assert got[n] == (min(hits)[1] if hits else None), a
    assert with_network(events, spark.createDataFrame([], "cidr string, zone string")).where("network is not null").count() == 0
    assert spark.range(1).select(address_bits(F.lit("255.0.0.1")).alias("b")).first().b == "4" + "1" * 8 + "0" * 23 + "1"


def test_split_positions_do_not_depend_on_partitioning(spark):
    rows = spark.range(5000).select(F.concat(F.lit("e"), "id").alias("event_id"), F.element_at(
        F.array(*map(F.lit, ("train", "train", "val", "test"))), (F.col("id") % 4 + 1).cast("int")).alias("split"))
    one = {r.event_id: (r.split, r.position) for r in split_positions(rows, 1, cell_rows=100).collect()}
    two = {r.event_id: (r.split, r.position) for r in split_positions(rows.repartition(13), 1, cell_rows=10**9).collect()}
    assert one == two
    for part, n in (("train", 2500), ("val", 1250), ("test", 1250)):
        assert sorted(p for s, p in one.values() if s == part) == list(range(n))
    other = {r.event_id: (r.split, r.position) for r in split_positions(rows, 2).collect()}
    assert sum(one[k] == other[k] for k in one) < 50
    assert split_positions(rows.limit(0), 1).count() == 0


def test_sketches_of_many_values_stay_small_and_close(spark):
    rows = spark.range(60_000).select(
        F.concat(F.lit("e"), "id").alias("event_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 2).alias("timestamp"),
        F.lit("10.0.0.1").alias("src_ip"), F.lit("h").alias("sensor"), F.concat(F.lit("r"), F.col("id") % 30_000).alias("rule_id"))
    last = rows.where("event_id in ('e0', 'e1000', 'e59999')")
    got = {r.event_id: r.approx_distinct for r in approx_distinct_24h(last, rows).collect()}
    assert got["e0"] == 0
    for event, exact in (("e1000", 1000), ("e59999", 30_000)):
        assert abs(got[event] - exact) <= 3 * 1.04 / 64 * exact
    sketches = slot_sketches(rows, lg_k=10)
    assert sketches.agg(F.max(F.length("sketch"))).first()[0] < 2000
    halves = slot_sketches(rows.where("rule_id < 'r2'")).unionByName(slot_sketches(rows.where("rule_id >= 'r2'")))
    united = halves.groupBy("key").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n")).collect()
    assert all(abs(r.n - 30_000) < 1500 for r in united)


def test_one_key_with_very_many_notices(spark):
    notices = spark.range(1_000_000).select(
        F.lit("parse_failure").alias("reason"), F.lit("h").alias("sensor"), F.timestamp_seconds(F.col("id") * 20).alias("at"))
    fired, left = coalesce_notices(notices, window_s=50, block_s=3600)  # a window holds three notices, whatever block it starts in
    row = fired.agg(F.count("*"), F.sum("count"), F.count_if(F.col("count") == 3), F.max(F.unix_micros("fired_at") % 60_000_000)).first()
    assert tuple(row) == (333_334, 999_999 + 1, 333_333, 0)
    assert left.first()["count"] == 1


def test_samples_round_trip(spark):
    path = fresh_path(spark, "samples")
    counters = spark.createDataFrame([("a_total", "", "", 3), ("b_total", "outcome", "success", 5)], "name string, label string, label_value string, count long")
    for day in range(3):
        write_samples(counter_samples(counters, T0 + timedelta(days=day)), path)
    got = sorted((r.series, r.value, r.ts.day) for r in read_samples(spark, path, since=T0 + timedelta(days=1)).collect())
    assert got == [("a_total{}", 3.0, 2), ("a_total{}", 3.0, 3), ('b_total{outcome="success"}', 5.0, 2), ('b_total{outcome="success"}', 5.0, 3)]
    assert read_samples(spark, path, "a_total").count() == 3


def events(spark, rows):
    return spark.createDataFrame([(f"e{i}", None if s is None else T0 + timedelta(seconds=s)) for i, s in rows], "event_id string, timestamp timestamp")


def test_late_rows_are_kept_counted_and_replayed_alike(spark):
    split = LateSplit(fresh_path(spark, "late"), delay_s=60)
    batches = [[(0, 0), (1, 100)], [(2, 40), (3, 41), (4, 300), (5, None)], [], [(6, 240), (7, 241), (8, 1)]]
    for n, rows in enumerate(batches):
        for _ in range(2 if n in (1, 3) else 1):  # some come again
            split.process(events(spark, rows), n)
    on_time = {r.event_id for r in split.table(spark, "on_time").collect()}
    late = {r.event_id: r.late_by_s for r in split.table(spark, "late").collect()}
    assert on_time == {"e0", "e1", "e3", "e4", "e7"} and late == {"e2": 0, "e5": None, "e6": 0, "e8": 239}
    counts = {r.batch_id: (r.late_rows, r.most_late_s) for r in late_counts(split.table(spark, "late")).collect()}
    assert counts == {1: (2, 0), 3: (2, 239)}
    assert [written(spark, batch_dir(f"{split.root}/clock", n)) for n in range(4)] == [False, False, True, True]


def test_progress_tells_what_the_state_dropped(spark):
    path = fresh_path(spark, "progress-in")
    state = fresh_path(spark, "progress-state")
    dropped = 0
    for rows in ([(0, 0), (1, 5000)], [(2, 10), (3, 5001)]):
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
        stream = dedupe_stream(spark.readStream.schema("event_id string, timestamp timestamp").parquet(path))
        query = stream.writeStream.format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
        late = progress_samples(spark, query, "dedupe").where("name = 'stream_rows_late'")
        dropped += late.agg(F.sum("value")).first()[0]
    assert dropped == 1


@pytest.mark.parametrize("fold", [2])
def test_folded_stream_state_is_bounded_and_changes_nothing(spark, monkeypatch, fold):
    monkeypatch.setattr(stream_triage, "FOLD", fold)
    from catalog.base import ALLOWLIST, alerts, decision_time, varied_scorer

    rows = alerts(spark, "/root/testdata/sf0.001").persist()
    results = []
    for parts in (6, 1):
        stream = stream_triage.TriageStream(spark, fresh_path(spark, "folded"), scorer=varied_scorer, allowlist=ALLOWLIST, now=decision_time())
        cuts = [rows.agg(F.percentile_approx("event_no", n / parts)).first()[0] for n in range(1, parts)]
        for n, (lo, hi) in enumerate(zip([-1, *cuts], [*cuts, 10**9])):
            part = rows.where((F.col("event_no") > lo) & (F.col("event_no") <= hi))
            for _ in range(2 if n == 4 else 1):  # the batch of a fold replays
                stream.process(part, n)
        results.append(sorted(tuple(r) for r in stream.table("decided").select(
            "event_id", "reason", "incident_group_key", "context.related_events_24h", "context.finding_seen_before").collect()))
        if parts > 1:
            held = [n for n in range(parts) if written(spark, batch_dir(f"{stream.root}/slots", n))]
            folds = [n for n in range(parts) if written(spark, f"{stream.root}/slots-folded/upto={n}")]
            assert held == [4, 5] and folds == [4]
            assert [n for n in range(parts) if written(spark, batch_dir(f"{stream.root}/sessions", n))] == [4, 5]
    assert results[0] == results[1]


def test_dead_letter_log_looks_history_up_once(spark, monkeypatch):
    from catalog import stores

    given, append = [], stores.append_dead_letters
    monkeypatch.setattr(stores, "append_dead_letters", lambda rows, path: (given.append(rows), append(rows, path)))
    assert stores.dead_letter_log(spark, "/root/testdata/sf0.001").count() == given[1].count() > 0
    assert len(given) == 3
    for rows in given:
        assert "Window" not in rows._jdf.queryExecution().optimizedPlan().toString()
