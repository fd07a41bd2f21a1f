"""Normalization, contract and scan behaviour on literal rows."""

import ipaddress
import json

from pyspark.sql import functions as F

from alertloom.functions.net import canonical_ip, is_ip
from alertloom.operators.contract import split_quarantine, validate_events
from alertloom.operators.normalize import normalize_alerts
from alertloom.schemas import RAW_ALERT, UNIFIED_EVENT
from alertloom.sources.alerts import alert_page, events_from_bus

LOGIN = {"id": "a1", "timestamp": "2031-03-04T05:06:07.000+0000",
         "rule": {"id": "4411", "description": "login refused", "level": 10, "groups": ["authentication", "sshd"],
                  "mitre": {"id": ["T1021.004"]}},
         "agent": {"id": "001", "name": "gate-7"}, "data": {"srcip": "198.51.100.77"}}
NIDS = {"id": "a2", "timestamp": "2031-03-04T05:06:07Z",
        "rule": {"id": "7002", "description": "probe seen", "level": 6, "groups": ["ids", "suricata"]},
        "agent": {"name": "sensor"},
        "data": {"srcip": "198.51.100.77", "dstip": "172.16.9.1", "srcport": "40123", "dstport": "22", "protocol": "TCP"}}


def normalized(spark, tmp_path, *docs):
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(d) for d in docs))
    df = normalize_alerts(spark.read.schema(RAW_ALERT).json(str(tmp_path / "raw.json")))
    return {r.event_id: r for r in df.collect()}


def with_(doc, **parts):
    return {**doc, **parts}


def test_login_and_nids_alerts(spark, tmp_path):
    rows = normalized(spark, tmp_path, LOGIN, NIDS)
    login, nids = rows["a1"], rows["a2"]
    assert (login.event_type, login.severity_hint, login.sensor) == ("HIDS", "high", "gate-7")
    assert login.mitre_technique_ids == ["T1021.004"] and login.violations == []
    assert (nids.event_type, nids.severity_hint, nids.src_port, nids.dst_port) == ("NIDS", "medium", 40123, 22)
    assert nids.mitre_technique_ids is None
    assert nids.raw_ref == "opensearch://wazuh-alerts-*/a2"


def test_bands_kinds_and_cleaning(spark, tmp_path):
    docs = [with_(LOGIN, id=f"l{n}", rule={"level": n, "groups": []}) for n in (0, 1, 4, 5, 9, 10, 13, 14, 15, 20)]
    docs += [
        with_(LOGIN, id="nolevel", rule={"groups": ["syscheck"]}),
        with_(LOGIN, id="badlevel", rule={"level": "high"}),
        with_(LOGIN, id="unknown", data={"srcip": "Unknown", "srcport": "not-a-port", "dstport": "99999"}),
        with_(LOGIN, id="badip", data={"srcip": "999.999.999.999"}),
        with_(LOGIN, id="naive", timestamp="2031-03-04T05:06:07"),
        with_(LOGIN, id="long", rule={"description": "x" * 600}),
        with_(LOGIN, id="plus2", timestamp="2031-03-04T07:06:07+02:00"),
        {"id": "bare"},
    ]
    rows = normalized(spark, tmp_path, *docs)
    bands = [rows[f"l{n}"].severity_hint for n in (0, 1, 4, 5, 9, 10, 13, 14, 15, 20)]
    assert bands == ["low"] * 3 + ["medium"] * 2 + ["high"] * 2 + ["critical"] * 3
    assert rows["l0"].event_type == "SIEM" and rows["nolevel"].event_type == "FIM"
    assert rows["badlevel"].violations == ["level_not_integer"]
    u = rows["unknown"]
    assert (u.src_ip, u.src_port, u.dst_port, u.violations) == (None, None, None, [])
    assert rows["badip"].violations == ["src_ip_invalid"]
    assert rows["naive"].violations == ["timestamp_invalid"]
    assert len(rows["long"].summary) == 500
    assert rows["plus2"].timestamp == rows["a1" if "a1" in rows else "l0"].timestamp
    assert rows["bare"].violations == ["timestamp_invalid"] and rows["bare"].sensor == "unknown"


def test_quarantine_keeps_no_text(spark, tmp_path):
    (tmp_path / "raw.json").write_text("\n".join(json.dumps(d) for d in [LOGIN, with_(LOGIN, id="x", timestamp=None), NIDS]))
    good, bad = split_quarantine(normalize_alerts(spark.read.schema(RAW_ALERT).json(str(tmp_path / "raw.json"))))
    assert good.count() == 2 and good.columns == UNIFIED_EVENT.names
    assert bad.columns == ["event_id", "source_module", "violations"] and bad.count() == 1


def test_ip_forms_match_the_standard_library(spark):
    texts = ["10.0.0.1", "010.0.0.1", "256.1.1.1", "1.2.3", "::", "::1", "1::", "2001:0DB8:0:0:0:0:0:1", "1:0:0:2:0:0:0:3",
             "1:0:0:2:2:0:0:3", "1:0:2:3:4:5:6:7", "1:2:3:4:5:6:7", "1::2::3", "fe80::1%eth0", "fe80::1%", "12345::", "g::",
             "0:0:0:0:0:0:0:0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", ":1::", "64:ff9b::1.2.3.4"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", is_ip(F.col("t")).alias("ok"), canonical_ip(F.col("t")).alias("c")).collect():
        try:
            want = str(ipaddress.ip_address(r.t))
        except ValueError:
            want = None
        assert (r.c if r.ok else None) == want, r.t


def test_contract_accepts_and_rejects(spark):
    base = {"event_id": "e", "schema_version": "unified-event@1", "source_module": "m", "sensor": "s", "source_alert_id": "a",
            "event_type": "t", "severity_hint": "low", "summary": "s", "raw_ref": "r"}
    cases = {
        "ok": {}, "host": {"src_ip": None}, "port": {"src_port": 65536}, "long": {"summary": "é" * 501}, "empty": {"summary": ""},
        "max": {"summary": "é" * 500}, "ip": {"dst_ip": "999.999.999.999"}, "version": {"schema_version": "unified-event@2"},
        "fits": {"fields": json.dumps({"k": "x" * 4087})}, "big": {"fields": json.dumps({"k": "x" * 4088})},
        "wide": {"fields": json.dumps({"k": "é" * 700}, ensure_ascii=False)}, "list": {"fields": "[1]"},
    }
    rows = [{**{n: None for n in UNIFIED_EVENT.names if n != "timestamp"}, **base, **c, "event_id": k} for k, c in cases.items()]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in UNIFIED_EVENT if f.name != "timestamp")
    df = spark.createDataFrame(rows, schema).withColumn("timestamp", F.lit("2026-01-01T00:00:00Z").cast("timestamp"))
    got = {r.event_id: r.violations for r in validate_events(df).collect()}
    assert got == {
        "ok": [], "host": [], "port": ["src_port_range"], "long": ["summary_length"], "empty": ["summary_length"], "max": [],
        "ip": ["dst_ip_invalid"], "version": ["schema_version_unknown"], "fits": [], "big": ["fields_too_large"],
        "wide": ["fields_too_large"], "list": ["fields_not_object"]}


def test_bus_message_with_unknown_column_is_rejected(spark):
    good = {"event_id": "e", "schema_version": "unified-event@1", "timestamp": "2026-01-01T00:00:00Z", "source_module": "m",
            "sensor": "s", "source_alert_id": "a", "event_type": "t", "severity_hint": "low", "summary": "s", "raw_ref": "r"}
    texts = [json.dumps(good), json.dumps({**good, "event_id": "x", "extra": 1}), "not json"]
    rows = events_from_bus(spark.createDataFrame([(t,) for t in texts], "data string")).collect()
    assert [r.violations == [] for r in rows] == [True, False, False]
    assert rows[1].violations == ["unknown_column"]


def test_page_resumes_inside_an_instant(spark):
    rows = spark.createDataFrame([(f"2026-01-01 00:00:0{i // 3}", f"i{i}") for i in range(9)], "ts string, id string")
    rows = rows.withColumn("timestamp", F.col("ts").cast("timestamp"))
    seen, after = [], None
    while True:
        page = alert_page(rows, after, limit=2).collect()
        if not page:
            break
        seen += [r.id for r in page]
        after = (page[-1].timestamp, page[-1].id)
    assert seen == [f"i{i}" for i in range(9)]
