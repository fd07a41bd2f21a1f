"""Prompt text for a scorer: byte-capped event JSON, injection screen, message assembly."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.columns import computed_once, iso_utc, let
from alertloom.schemas import CONTEXT, UNIFIED_EVENT

EVENT_MAX_BYTES = 8192
CONTEXT_MAX_BYTES = 1024
CUT_MARK = "[truncated]"
NEUTRAL = "[neutralized]"

# Free-text event columns that may be cut after the summary.
CUTTABLE = ("signature", "http_url", "http_user_agent", "dns_query", "process", "file_path", "username")

# Injection triggers.
TRIGGERS = (
    "ignore previous instructions",
    "ignore all instructions",
    "disregard previous instructions",
    "disregard all instructions",
    "you are now ",
    "new instructions:",
    "override instructions",
    "<|system|>",
    "<|user|>",
    "<|assistant|>",
    "<|im_start|>",
    "<|im_end|>",
    "[system]",
    "[user]",
    "[assistant]",
    "### system",
    "### user",
    "### assistant",
    "<|end_of_text|>",
    "<alert_data>",
    "</alert_data>",
    "<context>",
    "</context>",
)

# Soft hyphen, zero-width and joiner marks, byte-order mark.
_INVISIBLE = "[\\u00AD\\u200B-\\u200F\\u2060-\\u2064\\uFEFF]"


def _branches(words: list[str]) -> str:
    """Pattern for any of ``words``, common beginnings stated once, blanks allowed between characters."""
    out = []
    for first in dict.fromkeys(w[0] for w in words):
        rests = [w[1:] for w in words if w[0] == first]
        out.append(re.escape(first) + ("" if rests == [""] else " ?+" + _branches(rests)))
    return out[0] if len(out) == 1 else "(?:" + "|".join(out) + ")"


def trigger_pattern() -> str:
    """Any trigger, in any case, with at most one space before each character.

    Runs of spaces are collapsed first, so one optional space covers every spacing; no
    trigger begins another.  A look at the first character rejects most positions.
    """
    words = [t.replace(" ", "") for t in TRIGGERS]
    firsts = "".join(re.escape(c) + (c.upper() if c.isalpha() else "") for c in dict.fromkeys(w[0] for w in words))
    return f"(?i) ?+(?=[{firsts}]){_branches(words)}"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def canonicalize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Invisible characters dropped, NFKC, runs of spaces collapsed.

    NFKC has no JVM expression; only text with non-ASCII characters is handed to
    Python, every other row passes a null.  Plain ASCII text costs two length and
    substring tests.
    """
    rest = [c for c in df.columns if c not in cols]

    def visible(c: str) -> Column:
        return F.when(F.octet_length(c) != F.length(c), F.regexp_replace(c, _INVISIBLE, ""))

    out = computed_once(df, *df.columns, **{f"_{c}_wide": visible(c) for c in cols})
    out = out.withColumns({f"_{c}_nfkc": _nfkc(F.col(f"_{c}_wide")) for c in cols})
    out = computed_once(out, *rest, **{c: F.coalesce(f"_{c}_nfkc", c) for c in cols})
    spaced = {c: F.when(F.contains(c, F.lit("  ")), F.regexp_replace(c, " {2,}", " ")).otherwise(F.col(c)) for c in cols}
    return computed_once(out, *rest, **spaced).select(*df.columns)


def screen_text(df: DataFrame, cols: list[str]) -> DataFrame:
    """Replaces every injection trigger in ``cols``; adds ``<col>_hits``, how many there were."""
    pattern = trigger_pattern()
    return canonicalize(df, cols).withColumns(
        {f"{c}_hits": F.regexp_count(c, F.lit(pattern)) for c in cols}
        | {c: F.regexp_replace(c, pattern, NEUTRAL) for c in cols})


def event_json(df: DataFrame, without: tuple[str, ...] = (), replaced: dict[str, Column] | None = None) -> Column:
    """Compact JSON of the event's non-null contract columns, in contract order."""
    replaced, parts = replaced or {}, []
    for f in UNIFIED_EVENT:
        if f.name not in df.columns or f.name in without:
            continue
        if f.name in replaced:
            parts.append(replaced[f.name].alias(f.name))
        elif f.name == "timestamp":
            parts.append(iso_utc("timestamp").alias("timestamp"))
        elif f.name == "fields":
            parts.append(F.try_parse_json("fields").alias("fields"))
        else:
            parts.append(F.col(f.name))
    return F.to_json(F.struct(*parts))


def _utf8_prefix(text: Column, most: Column) -> Column:
    """The longest beginning of a text within ``most`` UTF-8 bytes."""
    raw = text.cast("binary")

    def starts_character(at: Column) -> Column:  # no byte 10xxxxxx stands there
        return ~F.hex(F.substring(raw, at + 1, F.lit(1))).rlike("^[89AB]")

    end = most
    for back in (3, 2, 1, 0):  # a character has four bytes at most
        end = F.when(starts_character(most - back), most - back).otherwise(end)
    return F.when(F.octet_length(text) <= most, text).otherwise(
        F.substring(raw, F.lit(1), F.greatest(end, F.lit(0))).cast("string"))


def _json_bytes(text: Column) -> Column:
    """Bytes of a text inside JSON, quotes and all, up to a constant."""
    return F.octet_length(F.to_json(F.struct(text.alias("t"))))


def _cuts(df: DataFrame, bare: Column, max_bytes: int) -> Column:
    """Name and shortened text of the columns that have to be cut, for an event of ``bare`` JSON without ``fields``.

    The free-text columns stand in the order they are cut in: the summary, then the longest (of equals, the one
    declared first).  A fold over them carries the event's size; each gives up what is still too much.
    """
    names = [n for n in ("summary", *CUTTABLE) if n in df.columns]
    fields = F.array_sort(F.array_compact(F.array(*[
        F.when(F.col(n).isNotNull(), F.struct(
            (F.lit(0) if n == "summary" else F.lit(1)).alias("turn"), (-F.octet_length(n)).alias("short"),
            F.lit(i).alias("place"), F.lit(n).alias("name"), F.col(n).alias("text")))
        for i, n in enumerate(names)])))
    none = F.array().cast("array<struct<name:string,text:string>>")

    def shortened(state: Column, field: Column) -> Column:
        spare = F.octet_length(field["text"]) - (state["size"] - max_bytes) - len(CUT_MARK)
        cut = F.concat(_utf8_prefix(field["text"], F.greatest(spare, F.lit(0))), F.lit(CUT_MARK))
        return let(cut, lambda c: F.struct(
            (state["size"] - _json_bytes(field["text"]) + _json_bytes(c)).alias("size"),
            F.concat(state["cuts"], F.array(F.struct(field["name"].alias("name"), c.alias("text")))).alias("cuts")))

    folded = F.aggregate(
        fields, F.struct(F.octet_length(bare).alias("size"), none.alias("cuts")),
        lambda state, field: F.when(state["size"] <= max_bytes, state).otherwise(shortened(state, field)))
    return F.map_from_entries(folded["cuts"])


def cap_event_json(df: DataFrame, max_bytes: int = EVENT_MAX_BYTES) -> DataFrame:
    """Adds ``event_json`` within the cap, ``event_bytes`` before it, and ``oversize``.

    An event over the cap loses ``fields`` first, then as much of its free text as needed.  ``event_json`` is null
    (and ``oversize`` true) for an event whose identifiers alone exceed the cap.
    """
    out = computed_once(df, *df.columns, _json=event_json(df)).withColumn("event_bytes", F.octet_length("_json"))
    over = F.col("event_bytes") > max_bytes
    out = computed_once(out, *out.columns, _cuts=F.when(over, _cuts(df, event_json(df, ("fields",)), max_bytes)))
    short = event_json(df, ("fields",), {
        n: F.coalesce(F.element_at("_cuts", F.lit(n)), F.col(n)) for n in ("summary", *CUTTABLE) if n in df.columns})
    out = computed_once(out, *out.columns, _short=F.when(over, short))
    fits = F.octet_length("_short") <= max_bytes
    return out.withColumns({
        "event_json": F.when(over, F.when(fits, F.col("_short"))).otherwise(F.col("_json")),
        "oversize": over & ~fits,
    }).drop("_json", "_short", "_cuts")


def context_json(context: str = "context") -> Column:
    return F.to_json(F.struct(*[F.col(f"{context}.{n}") for n in CONTEXT.names]))


def build_user_message(df: DataFrame, max_bytes: int = EVENT_MAX_BYTES) -> DataFrame:
    """Adds ``user_message``: event and context blocks, each screened after serialization.

    A context over its cap is a fault upstream and fails the job.
    """
    out = computed_once(cap_event_json(df, max_bytes), *df.columns, "event_bytes", "oversize",
                        _event=F.col("event_json"), _ctx=context_json())
    fits = F.octet_length("_ctx") <= CONTEXT_MAX_BYTES
    out = out.withColumn("_ctx", F.when(fits, F.col("_ctx")).otherwise(
        F.raise_error(F.lit(f"context exceeds {CONTEXT_MAX_BYTES} bytes"))))
    out = screen_text(out, ["_event", "_ctx"])
    message = F.concat(
        F.lit("<alert_data>\n"), "_event", F.lit("\n</alert_data>\n<context>\n"), "_ctx", F.lit("\n</context>"))
    return out.select(*df.columns, "event_bytes", "oversize", message.alias("user_message"))


def prompt_fingerprint(prompt: str) -> Column:
    return F.sha2(F.lit(prompt), 256)


def require_prompt(df: DataFrame, prompt: str, expected_sha256: str) -> DataFrame:
    """Adds ``prompt_sha256``; the job fails on its first row if the prompt is not the expected one."""
    found = prompt_fingerprint(prompt)
    return df.withColumn("prompt_sha256", F.when(found == expected_sha256.lower(), found).otherwise(
        F.raise_error(F.lit("system prompt does not match its expected fingerprint"))))
