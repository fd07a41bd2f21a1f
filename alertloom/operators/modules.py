"""Normalizers of further alert sources: network sensor events, cloud audit records and flow logs.

Each takes a column ``value`` of raw lines and gives the unified columns and ``violations``.  JSON sources are parsed to
VARIANT once, so records of different shapes share a scan; flow logs are split at spaces.  ``normalize_lines`` dispatches
mixed lines by their module and sends unknown modules to the quarantine.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.columns import aware_timestamp, blank_to_null, computed_once
from alertloom.functions.net import is_ip
from alertloom.operators.contract import event_violations
from alertloom.operators.normalize import SUMMARY_MAX, clean_ip, clean_port, register_normalizer
from alertloom.schemas import SCHEMA_VERSION, UNIFIED_EVENT

# Names of the sources and of their public formats.
EVE, AUDIT, FLOW = "suricata", "cloudtrail", "vpcflow"
EVE_SEVERITY = {"1": "high", "2": "medium", "3": "low"}
FLOW_FIELDS = ("version", "account", "interface", "srcaddr", "dstaddr", "srcport", "dstport", "protocol", "packets",
               "bytes", "start", "end", "action", "status")
PROTOCOLS = {"1": "ICMP", "6": "TCP", "17": "UDP"}


def _text(path: str) -> Column:
    return blank_to_null(F.try_variant_get("_v", path, "string"))


def _named(c: Column, table: dict[str, str], other: Column) -> Column:
    out = other
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def _events(rows: DataFrame, module: str, cols: dict[str, Column], shape: Column) -> DataFrame:
    """The unified columns; ``shape`` is true for lines that have the source's form at all."""
    base = {"schema_version": F.lit(SCHEMA_VERSION), "source_module": F.lit(module),
            "raw_ref": F.concat(F.lit(f"{module}://"), cols["event_id"]), "source_alert_id": cols["event_id"]}
    cols = base | cols
    typed = {f.name: cols.get(f.name, F.lit(None)).cast(f.dataType) for f in UNIFIED_EVENT}
    typed["summary"] = F.substring(typed["summary"], 1, SUMMARY_MAX)
    out = computed_once(rows, "value", **typed, _shape=F.coalesce(shape, F.lit(False)))
    return computed_once(out, *UNIFIED_EVENT.names, violations=event_violations(False, F.when(~F.col("_shape"), f"not_{module}")))


def _parsed(lines: DataFrame) -> DataFrame:
    return computed_once(lines, "value", _v=F.try_parse_json("value"))


def normalize_sensor_events(lines: DataFrame) -> DataFrame:
    """Alerts of a network sensor's event log, one JSON object per line; other event types are no alerts."""
    alert, rrname = _text("$.alert.signature"), F.coalesce(_text("$.dns.rrname"), _text("$.dns.query[0].rrname"))
    rule = _text("$.alert.signature_id")
    return _events(_parsed(lines), EVE, {
        "event_id": F.concat(_text("$.flow_id"), F.lit("-"), rule, F.lit("-"), _text("$.timestamp")),
        "timestamp": aware_timestamp(_text("$.timestamp")), "sensor": F.coalesce(_text("$.host"), F.lit("unknown")),
        "event_type": F.lit("NIDS"), "severity_hint": _named(_text("$.alert.severity"), EVE_SEVERITY, F.lit("low")),
        "summary": F.coalesce(alert, _text("$.alert.category")), "signature": alert, "rule_id": rule,
        "src_ip": clean_ip(_text("$.src_ip")), "dst_ip": clean_ip(_text("$.dest_ip")),
        "src_port": clean_port(_text("$.src_port")), "dst_port": clean_port(_text("$.dest_port")), "protocol": _text("$.proto"),
        "http_url": _text("$.http.url"), "http_user_agent": _text("$.http.http_user_agent"), "dns_query": rrname,
    }, _text("$.event_type") == "alert")


def normalize_audit_records(lines: DataFrame) -> DataFrame:
    """Records of a cloud account's audit trail; a source that is a service name, not an address, is no source address."""
    name, error = _text("$.eventName"), _text("$.errorCode")
    source = _text("$.sourceIPAddress")
    return _events(_parsed(lines), AUDIT, {
        "event_id": _text("$.eventID"), "timestamp": aware_timestamp(_text("$.eventTime")),
        "sensor": F.coalesce(_text("$.awsRegion"), F.lit("unknown")), "event_type": F.lit("CLOUD"),
        "severity_hint": F.when(error.isNotNull(), "medium").otherwise("low"),
        "summary": F.concat_ws(" ", name, F.concat(F.lit("on "), _text("$.eventSource")), F.concat(F.lit("failed: "), error)),
        "rule_id": name, "src_ip": F.when(is_ip(source), clean_ip(source)),
        "username": F.coalesce(_text("$.userIdentity.userName"), _text("$.userIdentity.arn")),
        "http_user_agent": _text("$.userAgent"),
    }, name.isNotNull())


def normalize_flow_logs(lines: DataFrame) -> DataFrame:
    """Space-separated flow records of version 2.  ``-`` stands for no value; records without data are quarantined."""
    rows = computed_once(lines, "value", _f=F.split(F.trim("value"), " +"))

    def field(name: str) -> Column:
        c = F.get("_f", F.lit(FLOW_FIELDS.index(name)))
        return F.when(c != "-", c)

    start = field("start").try_cast("long")
    return _events(rows, FLOW, {
        "event_id": F.when(field("interface").isNotNull(), F.sha1(F.trim("value"))), "timestamp": F.timestamp_seconds(start),
        "sensor": field("interface"), "event_type": F.lit("FLOW"),
        "severity_hint": F.when(field("action") == "REJECT", "medium").otherwise("low"),
        "summary": F.concat_ws(" ", field("action"), F.concat(field("bytes"), F.lit(" bytes in")), F.concat(field("packets"), F.lit(" packets"))),
        "rule_id": F.lower(field("action")), "src_ip": clean_ip(field("srcaddr")), "dst_ip": clean_ip(field("dstaddr")),
        "src_port": clean_port(field("srcport")), "dst_port": clean_port(field("dstport")),
        "protocol": _named(field("protocol"), PROTOCOLS, field("protocol")),
    }, (F.size("_f") == len(FLOW_FIELDS)) & (field("version") == "2") & field("status").isin("OK"))


LINE_NORMALIZERS = {EVE: normalize_sensor_events, AUDIT: normalize_audit_records, FLOW: normalize_flow_logs}
for _module, _transform in LINE_NORMALIZERS.items():
    register_normalizer(_module, _transform)


def normalize_lines(lines: DataFrame, module: str = "module", value: str = "value") -> DataFrame:
    """Mixed lines, each by its module's normalizer; a line of another module breaks the rule ``unknown_module``."""
    rows = lines.select(F.col(module).alias("_module"), F.col(value).alias("value"))
    out = None
    for name, transform in LINE_NORMALIZERS.items():
        part = transform(rows.where(F.col("_module") == name).select("value"))
        out = part if out is None else out.unionByName(part)
    others = rows.where(~F.coalesce(F.col("_module").isin(*LINE_NORMALIZERS), F.lit(False)))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in UNIFIED_EVENT} | {"source_module": F.col("_module")}
    return out.unionByName(others.select(*(c.alias(n) for n, c in nothing.items()), F.array(F.lit("unknown_module")).alias("violations")))
