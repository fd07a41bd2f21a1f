"""Text of notifications and system notices, one row per message."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertloom.functions.net import defang

# Words and marks of the message layout.
SEVERITY_MARK = {"critical": "🔴", "high": "🟠", "medium": "🟡", "low": "⚪"}
CLASS_WORD = {"alert": "ALERT", "informational": "INFO", "noise": "noise"}
YES, NO, NONE = "sí", "no", "—"
WHY = "Por qué: "
EVIDENCE = "Evidencia (context):"
ACTIONS = "Acciones sugeridas (NO ejecutadas):"
DEGRADED_BODY = "OpenSearch lookup failed — zeroed context enviado al modelo (in-distribution)."
AGED_BODY = (
    "Events older than notify_max_event_age were suppressed — "
    "still queryable in OpenSearch (ADR-0004 D-16)."
)


def _pick(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for key, value in table.items():
        out = F.when(c == key, value).otherwise(out)
    return out


def _yes_no(c: str) -> Column:
    return F.when(F.col(c), YES).otherwise(NO)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _non_empty_lines(*lines: Column) -> Column:
    return F.array_join(F.filter(F.array(*lines), lambda ln: ln != ""), "\n")


def escape_markup(c: Column) -> Column:
    c = F.replace(c, F.lit("&"), F.lit("&amp;"))
    c = F.replace(c, F.lit("<"), F.lit("&lt;"))
    return F.replace(c, F.lit(">"), F.lit("&gt;"))


def render_notification(markup: bool) -> Column:
    """Message over the notification columns; ``markup`` escapes the scorer's own words.

    Only address columns are defanged, free text never is.
    """
    said = escape_markup if markup else (lambda c: c)
    # format_number rounds the binary value half-even; format_string would round its decimal text.
    header = _text(_pick(F.col("severity"), SEVERITY_MARK), " ", F.upper("severity"), " · ",
                   _pick(F.col("classification"), CLASS_WORD), "   conf. ", F.format_number("confidence", 2))
    flags = F.array_join(F.transform("flags", lambda f: F.replace(f, F.lit("_"), F.lit(" "))), ", ")
    numbered = F.transform("suggested_actions", lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), said(a)))
    src, dst = (F.coalesce(F.when(F.col(c) != "", defang(F.col(c))), F.lit(NONE)) for c in ("src_ip", "dst_ip"))
    return _non_empty_lines(
        header,
        F.when(F.size("flags") > 0, _text("⚑ ", flags)).otherwise(""),
        said(F.col("summary")),
        _text(WHY, said(F.col("rationale"))),
        F.lit(EVIDENCE),
        _text("· IP vista antes (30d): ", _yes_no("src_ip_seen_before"),
              "   · eventos 24h: ", F.col("related_events_24h")),
        _text("· reglas distintas 24h: ", F.col("distinct_rules_from_src_24h"),
              "   · últimos 10 min: ", F.col("events_last_10min")),
        _text("· en allowlist: ", _yes_no("src_in_allowlist")),
        F.lit(ACTIONS),
        F.array_join(numbered, "\n"),
        _text("regla ", F.col("matched_rule"), " · src ", src, " → dst ", dst),
        _text("incidente ", F.col("incident_group_key"), " · sensor ", F.col("sensor")),
    )


def render_system_notice(count: str | Column = "count") -> Column:
    """Message over the system-notice columns and how many notices it stands for."""
    n = F.col(count) if isinstance(count, str) else count
    where = _text(" · sensor ", F.col("sensor"), " · severity ", F.upper("severity"))
    kind = F.col("kind")
    header = (
        F.when(kind == "enrichment_degraded", _text("⚑ enrichment degraded", where))
        .when(kind == "age_suppressed", _text("⏳ age-suppressed", where))
        .otherwise(_text("⚠️ unclassified (system) · ", F.col("reason"), where))
    )
    facts = F.concat_ws(
        "   ", F.when(F.col("detail") != "", _text("detail: ", F.col("detail"))),
        F.when(F.col("retry_count").isNotNull(), _text("retry_count: ", F.col("retry_count"))))
    body = F.when(kind == "enrichment_degraded", DEGRADED_BODY).when(
        kind == "age_suppressed", AGED_BODY).otherwise(facts)
    suffix = F.when(n > 1, _text("×", n, " en la última ventana")).otherwise("")
    return _non_empty_lines(header, body, suffix)


def slack_payload(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("text"), F.lit(True).alias("mrkdwn")))
