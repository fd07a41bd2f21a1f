"""Column contracts of every table the library reads or writes."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SCHEMA_VERSION = "unified-event@1"

# Enumerations of the contracts, lowest rank first.
CLASSIFICATIONS = ("noise", "informational", "alert")
SEVERITIES = ("low", "medium", "high", "critical")
DEAD_LETTER_REASONS = ("parse_failure", "model_unavailable")

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS, _TEXTS = T.TimestampType(), T.ArrayType(T.StringType())


def columns(nullable: bool = True, /, **types: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, t, nullable) for name, t in types.items()])


# Numeric leaves of a raw alert are read as text so that one odd value
# quarantines its row instead of failing the scan.
RAW_ALERT = columns(
    id=_S,
    timestamp=_S,
    rule=columns(id=_S, description=_S, level=_S, groups=_TEXTS, mitre=columns(id=_TEXTS)),
    agent=columns(id=_S, name=_S),
    data=columns(srcip=_S, dstip=_S, srcport=_S, dstport=_S, protocol=_S),
)

UNIFIED_EVENT = T.StructType(
    columns(
        False, event_id=_S, schema_version=_S, timestamp=_TS, source_module=_S, sensor=_S,
        source_alert_id=_S, event_type=_S, severity_hint=_S, summary=_S, raw_ref=_S,
    ).fields
    + columns(
        src_ip=_S, dst_ip=_S, src_port=_I, dst_port=_I, protocol=_S, signature=_S, rule_id=_S,
        username=_S, process=_S, file_path=_S, file_hash=_S, http_url=_S, http_user_agent=_S,
        dns_query=_S, mitre_technique_ids=_TEXTS, fields=_S,  # fields: a JSON object as text
    ).fields
)
REQUIRED_EVENT_COLUMNS = [f.name for f in UNIFIED_EVENT if not f.nullable]

CONTEXT = columns(
    src_ip_seen_before=_B, related_events_24h=_L, distinct_rules_from_src_24h=_L,
    events_last_10min=_L, src_in_allowlist=_B, finding_seen_before=_B, matched_rule=_S,
    lookup_degraded=_B,
)

MODEL_OUTPUT = columns(classification=_S, confidence=_D, summary=_S, suggested_actions=_TEXTS, rationale=_S)

TRIAGE_RECORD = columns(
    alert_id=_S, event_id=_S, classification=_S, confidence=_D, severity=_S, summary=_S,
    incident_group_key=_S, context=CONTEXT, suggested_actions=_TEXTS, rationale=_S, triaged_at=_TS,
)

DEAD_LETTER = columns(
    alert_id=_S, event_id=_S, source_module=_S, sensor=_S, severity=_S, reason=_S,
    retry_count=_I, dead_lettered_at=_TS, detail=_S,
)

NOTIFICATION = columns(
    severity=_S, classification=_S, confidence=_D, summary=_S, rationale=_S, src_ip_seen_before=_B,
    related_events_24h=_L, distinct_rules_from_src_24h=_L, events_last_10min=_L, src_in_allowlist=_B,
    suggested_actions=_TEXTS, matched_rule=_S, src_ip=_S, dst_ip=_S, sensor=_S,
    incident_group_key=_S, flags=_TEXTS,
)

SYSTEM_NOTICE = columns(kind=_S, sensor=_S, severity=_S, reason=_S, retry_count=_I, detail=_S)

METRIC_SAMPLE = columns(ts=_TS, name=_S, labels=T.MapType(_S, _S), value=_D)


def require_columns(df: DataFrame, names: list[str], where: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{where}: missing columns {missing}")


def require_exactly(df: DataFrame, schema: T.StructType, where: str) -> DataFrame:
    """Closed-allowlist check: the frame has the contract's columns and no others."""
    extra = sorted(set(df.columns) - set(schema.names))
    missing = sorted(set(schema.names) - set(df.columns))
    if extra or missing:
        raise ValueError(f"{where}: unexpected columns {extra}, missing columns {missing}")
    return df.select(*schema.names)
