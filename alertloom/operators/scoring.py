"""Classification: the rubric, scorer plug-in, strict output validation, attempts."""

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.columns import blank_to_null, computed_once, let, severity_of
from alertloom.schemas import CLASSIFICATIONS, DEAD_LETTER, MODEL_OUTPUT
from alertloom.session import stage

MAX_ATTEMPTS = 2

# Path fragments and words the rubric looks for.
SENSITIVE_PATHS = ("/etc/passwd", "/etc/shadow", "/etc/sudoers", "sshd_config", "crontab")
PACKAGE_PATHS = ("/var/lib/dpkg/", "/var/cache/apt/")
LOGIN_WORDS = ("auth", "login", "ssh", "brute")
HOST_KINDS = ("syscheck", "rootcheck", "fim")
NETWORK_KINDS = ("NIDS", "ids", "suricata")


def _contains_any(c: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return F.coalesce(hit, F.lit(False))


def rubric_label(fold_case: bool = False, context: str = "context") -> Column:
    """Deterministic class from event columns and ``context``; null means undecided.

    Kinds are compared case-sensitively unless ``fold_case``.
    """
    ctx = F.col(context)
    kind = F.lower("event_type") if fold_case else F.col("event_type")
    network = tuple(k.lower() for k in NETWORK_KINDS) if fold_case else NETWORK_KINDS
    file_path = blank_to_null("file_path")
    related = ctx["related_events_24h"]
    busy = (ctx["events_last_10min"] >= 3) | (related >= 5) | (ctx["distinct_rules_from_src_24h"] >= 2)
    unheard = ~ctx["src_ip_seen_before"] & (related == 0)
    sig = F.lower(F.coalesce(blank_to_null("signature"), blank_to_null("rule_id"), F.lit("")))
    login = F.when(related >= 4, "alert").otherwise("informational")
    return (
        F.when(kind.isin(*HOST_KINDS),
               F.when(_contains_any(file_path, SENSITIVE_PATHS), "alert")
               .when(_contains_any(file_path, PACKAGE_PATHS), "noise")
               .otherwise("informational"))
        .when(ctx["src_in_allowlist"], "informational")
        .when(kind.isin(*network) & busy, "alert")
        .when(kind.isin(*network) & unheard, "noise")
        .when(_contains_any(sig, LOGIN_WORDS), login)
        .when(F.contains("signature", F.lit("[neutralized]")), "alert")
    )


Scorer = Callable[[DataFrame], DataFrame]
"""Adds ``attempts ARRAY<STRING>``: raw answers in the order they were made."""


def rubric_scorer(df: DataFrame, undecided: str = "informational") -> DataFrame:
    """Default scorer: answers with the rubric's class as well-formed JSON, no model needed.

    Rows the rubric leaves to a human get ``undecided`` at confidence 0.5.
    """
    label = rubric_label()
    answer = F.struct(
        F.coalesce(label, F.lit(undecided)).alias("classification"),
        F.when(label.isNull(), 0.5).otherwise(0.9).alias("confidence"),
        F.substring("summary", 1, 200).alias("summary"),
        F.array().cast("array<string>").alias("suggested_actions"),
        F.concat(F.lit("rubric: "), F.coalesce(label, F.lit("undecided"))).alias("rationale"),
    )
    return df.withColumn("attempts", F.array(F.to_json(answer)))


def _violations(v: Column, keys: Column) -> Column:
    """Rules broken by a parsed answer ``v`` with top-level ``keys``."""
    want = F.array(*[F.lit(n) for n in MODEL_OUTPUT.names])

    def kind(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))

    def text(key: str) -> Column:
        return F.when(kind(key) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))

    number = F.when(kind("confidence").rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, "$.confidence", "double"))
    actions = F.when(kind("suggested_actions").isin("ARRAY<STRING>", "ARRAY<VOID>"),
                     F.try_variant_get(v, "$.suggested_actions", "array<string>"))
    checks = [
        (F.size(F.array_except(keys, want)) == 0, "extra_key"),
        (F.size(F.array_except(want, keys)) == 0, "missing_key"),
        (text("classification").isin(*CLASSIFICATIONS), "classification"),
        (number.between(0.0, 1.0), "confidence"),
        (F.length(text("summary")) <= 200, "summary"),
        ((F.size(actions) <= 10) & F.forall(actions, lambda a: F.length(a).between(1, 200)), "suggested_actions"),
        (F.length(text("rationale")) <= 500, "rationale"),
    ]
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def _fields(v: Column) -> Column:
    return F.struct(*[
        F.try_variant_get(v, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in MODEL_OUTPUT])


def judge_output(raw: str | Column) -> Column:
    """Struct of ``broken`` (names of the rules a raw answer breaks) and the typed ``output``.

    The answer must be one JSON object with exactly the five contract keys, each of
    its own JSON type: nothing is converted, fenced or trailing text is not JSON.
    """
    raw = F.col(raw) if isinstance(raw, str) else raw
    not_object = F.array(F.lit("not_json_object"))

    def judged(v: Column) -> Column:
        broken = F.when(F.schema_of_variant(v).startswith("OBJECT<"), _violations(v, F.json_object_keys(raw)))
        return F.struct(F.coalesce(broken, not_object).alias("broken"), _fields(v).alias("output"))

    return let(F.try_parse_json(raw), judged)


def validate_output(df: DataFrame, raw: str) -> DataFrame:
    """Adds ``broken`` and ``output`` for one column of raw answers; ``output`` is null if any rule is."""
    out = computed_once(df, *df.columns, _j=judge_output(raw))
    return out.select(*df.columns, F.col("_j.broken").alias("broken"),
                      F.when(F.size("_j.broken") == 0, F.col("_j.output")).alias("output"))


def resolve_attempts(df: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """First valid answer of at most ``max_attempts``; the row's ``output`` is null if none is.

    Adds ``output`` and, for failures, ``failed_rules``: the distinct rule names the last
    answer broke, in order, never the answer's text.
    """
    tried = F.transform(F.slice("attempts", 1, max_attempts), judge_output)
    out = computed_once(df, *df.columns, _tried=tried)
    good = F.get(F.filter("_tried", lambda j: F.size(j["broken"]) == 0), F.lit(0))
    last = F.get("_tried", F.size("_tried") - 1)
    none = F.array(F.lit("no_answer"))
    out = computed_once(out, *df.columns, output=good["output"], _last=F.coalesce(last["broken"], none))
    return out.select(*df.columns, "output", F.when(
        F.col("output").isNull(), F.array_distinct("_last")).alias("failed_rules"))


def retrying(ask: Callable[[DataFrame, int], DataFrame], max_attempts: int = MAX_ATTEMPTS) -> Scorer:
    """A scorer that asks again only where the last answer was invalid.

    ``ask(rows, attempt)`` adds ``answer`` to the rows it is given, knowing the attempt's number (from 1).  Each
    attempt's answers are written once, so that a costly one is not asked again for the next.
    """
    def score(df: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        open_, done = df.withColumn("attempts", none), []
        for attempt in range(1, max_attempts + 1):
            asked = ask(open_, attempt).withColumn("attempts", F.concat("attempts", F.array("answer"))).drop("answer")
            judged = computed_once(asked, *asked.columns, _broken=judge_output(F.element_at("attempts", -1))["broken"])
            judged = stage(judged.withColumn("_valid", F.size("_broken") == 0).drop("_broken"), f"attempt-{attempt}")
            last = attempt == max_attempts
            done.append((judged if last else judged.where("_valid")).drop("_valid"))
            open_ = judged.where("not _valid").drop("_valid")
        return reduce(DataFrame.unionByName, done)
    return score


def scored_rows(resolved: DataFrame) -> DataFrame:
    """Rows with a valid answer, its five columns in place (event summary moves aside)."""
    keep = [c for c in resolved.columns if c not in ("attempts", "output", "failed_rules", "summary")]
    return resolved.where("output is not null").select(
        *keep, F.col("summary").alias("event_summary"), "output.*")


def dead_letters(resolved: DataFrame, now: datetime | Column, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """One record per event without a valid answer."""
    now = F.lit(now) if isinstance(now, datetime) else now
    detail = F.concat(
        F.lit(f"ValidationError after {max_attempts} attempts: "), F.array_join("failed_rules", ", "))
    return resolved.where("output is null").select(
        F.col("source_alert_id").alias("alert_id"), "event_id", "source_module", "sensor",
        F.col("severity_hint").alias("severity"), F.lit("parse_failure").alias("reason"),
        F.lit(max_attempts).alias("retry_count"), now.cast("timestamp").alias("dead_lettered_at"),
        F.substring(detail, 1, 500).alias("detail"),
    ).select(*DEAD_LETTER.names)


def triage_records(decided: DataFrame, now: datetime | Column) -> DataFrame:
    """The stored record; severity comes from the event, never from the answer."""
    now = F.lit(now) if isinstance(now, datetime) else now
    return decided.select(
        F.col("source_alert_id").alias("alert_id"), "event_id", "classification", "confidence",
        severity_of("severity_hint").alias("severity"), "summary", "incident_group_key",
        "context", "suggested_actions", "rationale", now.cast("timestamp").alias("triaged_at"))
