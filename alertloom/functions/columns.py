"""Small column expressions shared by the operators."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MICROS = 1_000_000


def computed_once(df: DataFrame, *keep: str, **cols: Column) -> DataFrame:
    """``keep`` plus ``cols``, each evaluated once per row.

    Above the projection stands a generator of one row over its results: the optimizer
    copies a projection's expressions neither into later filters nor into later
    projections across it.  The expressions themselves stay in a compiled projection.
    """
    held = df.select(*keep, *[c.alias(f"_once_{n}") for n, c in cols.items()])
    row = F.struct(*[F.col(f"_once_{n}").alias(n) for n in cols])
    return held.select(*keep, F.inline(F.array(row)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, inside another lambda's body."""
    return F.transform(F.array(value), body)[0]


def present(*names: Column) -> Column:
    """The non-null names (without commas) as an array; unlike a lambda filter it compiles."""
    text = F.concat_ws(",", *names)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def micros(ts: str | Column) -> Column:
    """Epoch microseconds; TIMESTAMP_NTZ input is read as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def cell_of(us: Column, width: int) -> Column:
    """Number of the time cell of ``width`` microseconds that holds ``us``."""
    return ((us - F.pmod(us, F.lit(width))) / F.lit(width)).cast("long")


def blank_to_null(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)


def matched_rule(rule_id: str = "rule_id", signature: str = "signature",
                 event_type: str = "event_type") -> Column:
    """Rule id, else signature, else kind; an empty string counts as missing."""
    return F.coalesce(blank_to_null(rule_id), blank_to_null(signature), F.col(event_type))


def source_key(src_ip: str = "src_ip", sensor: str = "sensor") -> Column:
    return F.coalesce(F.col(src_ip), F.col(sensor))


def signature_key() -> Column:
    """What makes two events the same burst: the source (or sensor) and the rule."""
    return F.concat(source_key(), F.lit(":"), matched_rule())


def severity_from_level(level: Column) -> Column:
    return (
        F.when(level >= 14, "critical").when(level >= 10, "high")
        .when(level >= 5, "medium").otherwise("low")
    )


def severity_of(hint: str | Column) -> Column:
    """The hint if it names a severity in any case, else low."""
    h = F.lower(F.col(hint) if isinstance(hint, str) else hint)
    return F.when(h.isin("low", "medium", "high", "critical"), h).otherwise("low")


def class_rank(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c == "alert", 2).when(c == "informational", 1).when(c == "noise", 0)


_OFFSET = r"(?:Z|[+-]\d{2}(?::?\d{2})?)"
_COMMON = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-]\d{2}:?\d{2})"
_ISO = rf"^(\d{{4}}-\d{{2}}-\d{{2}}|\d{{8}})(?:[T ](\d{{2}})(?::?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d+))?)?)?({_OFFSET})?)?\z"


def iso_instant(text: Column, offset_required: bool) -> Column:
    """ISO 8601 date or date and time, extended or basic, to an instant; null for anything else.

    A time alone is no instant.  Without an offset the text means UTC, or nothing if one is required.
    """
    def part(n: int) -> Column:
        return F.regexp_extract(text, _ISO, n)

    def or_zero(n: int) -> Column:
        return F.when(part(n) == "", "00").otherwise(part(n))

    offset = F.regexp_replace(F.regexp_replace(part(6), r"^([+-]\d{2})\z", "$1:00"), r"^([+-]\d{2})(\d{2})\z", "$1:$2")
    rebuilt = F.concat(
        F.regexp_replace(part(1), r"^(\d{4})(\d{2})(\d{2})\z", "$1-$2-$3"), F.lit("T"), or_zero(2), F.lit(":"), or_zero(3),
        F.lit(":"), or_zero(4), F.lit("."), F.rpad(F.substring(part(5), 1, 6), 6, "0"),
        F.when(offset == "", "Z").otherwise(offset))
    known = text.rlike(_ISO) & (part(6) != "") if offset_required else text.rlike(_ISO)
    return F.when(text.rlike(_COMMON + r"\z"), F.try_to_timestamp(text)).when(known, F.try_to_timestamp(rebuilt))


def aware_timestamp(text: Column) -> Column:
    """Timestamp text to an instant; null unless the text carries its UTC offset."""
    return iso_instant(text, offset_required=True)


def iso_utc(ts: str | Column) -> Column:
    """ISO text ending in Z, with six fraction digits only when there is a fraction."""
    t = F.col(ts) if isinstance(ts, str) else ts
    frac = F.pmod(F.unix_micros(t), F.lit(MICROS))
    return F.concat(
        F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(frac != 0, F.concat(F.lit("."), F.lpad(frac.cast("string"), 6, "0"))).otherwise(""),
        F.lit("Z"),
    )


def seeded_hash(seed: int, *cols: str) -> Column:
    """Deterministic non-negative pseudo-random long per row."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.col(c) for c in cols]), F.lit(2**62))
