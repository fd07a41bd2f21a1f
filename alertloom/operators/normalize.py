"""Raw alert documents to unified events."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.columns import aware_timestamp, blank_to_null, computed_once, severity_from_level
from alertloom.functions.net import canonical_ip
from alertloom.operators.contract import event_violations
from alertloom.schemas import SCHEMA_VERSION, UNIFIED_EVENT

# Names of the built-in alert source.
SOURCE_MODULE = "wazuh"
RAW_REF_PREFIX = "opensearch://wazuh-alerts-*/"
DEFAULT_SUMMARY = "Wazuh alert"
SUMMARY_MAX = 500

# Rule tags that decide the kind, first match wins.
KIND_TAGS = (
    ("NIDS", ("ids", "suricata")),
    ("FIM", ("syscheck", "fim")),
    ("HIDS", ("authentication", "sshd", "win_authentication")),
)


def kind_from_tags(tags: Column) -> Column:
    tags = F.coalesce(tags, F.array().cast("array<string>"))
    kind = F.lit("SIEM")
    for name, members in reversed(KIND_TAGS):
        hit = F.arrays_overlap(tags, F.array(*[F.lit(m) for m in members]))
        kind = F.when(hit, name).otherwise(kind)
    return kind


def clean_ip(c: Column) -> Column:
    return F.when(~F.lower(c).isin("unknown", "none", ""), canonical_ip(c))


def clean_port(c: Column) -> Column:
    port = c.try_cast("int")
    return F.when(port.between(0, 65535), port)


def normalize_alerts(raw: DataFrame) -> DataFrame:
    """One projection from the raw nested schema to the unified event columns.

    Adds ``violations``, the names of the contract rules the row breaks; an empty
    array means the row is a valid event.  Missing nested blocks behave as empty.
    """
    level_text = blank_to_null("rule.level")
    level = F.coalesce(level_text.try_cast("int"), F.lit(0))
    nothing = F.lit(None).cast("string")
    cols = {
        "event_id": F.col("id"),
        "schema_version": F.lit(SCHEMA_VERSION),
        "timestamp": aware_timestamp(F.col("timestamp")),
        "source_module": F.lit(SOURCE_MODULE),
        "sensor": F.coalesce(blank_to_null("agent.name"), F.lit("unknown")),
        "source_alert_id": F.col("id"),
        "event_type": kind_from_tags(F.col("rule.groups")),
        "severity_hint": severity_from_level(level),
        "summary": F.substring(
            F.coalesce(blank_to_null("rule.description"), F.lit(DEFAULT_SUMMARY)), 1, SUMMARY_MAX),
        "raw_ref": F.concat(F.lit(RAW_REF_PREFIX), F.col("id")),
        "src_ip": clean_ip(F.col("data.srcip")),
        "dst_ip": clean_ip(F.col("data.dstip")),
        "src_port": clean_port(F.col("data.srcport")),
        "dst_port": clean_port(F.col("data.dstport")),
        "protocol": blank_to_null("data.protocol"),
        "rule_id": F.col("rule.id"),
        "mitre_technique_ids": F.col("rule.mitre.id"),
    }
    typed = {f.name: cols.get(f.name, nothing).cast(f.dataType) for f in UNIFIED_EVENT}
    bad_level = F.col("rule.level").isNotNull() & F.col("rule.level").try_cast("int").isNull()
    out = computed_once(raw, **typed, _bad_level=bad_level)
    found = event_violations(False, F.when(F.col("_bad_level"), "level_not_integer"))
    return computed_once(out, *UNIFIED_EVENT.names, violations=found)


Normalizer = Callable[[DataFrame], DataFrame]
NORMALIZERS: dict[str, Normalizer] = {SOURCE_MODULE: normalize_alerts}


def register_normalizer(source_module: str, transform: Normalizer) -> None:
    """Plug in another alert source: a transform to the unified columns plus ``violations``."""
    NORMALIZERS[source_module] = transform


def normalize(source_module: str, raw: DataFrame) -> DataFrame:
    if source_module not in NORMALIZERS:
        raise KeyError(f"no normalizer registered for {source_module!r}")
    return NORMALIZERS[source_module](raw)
