"""Alert scans: whole tables, keyset pages, bus messages."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.columns import aware_timestamp, computed_once, present
from alertloom.functions.net import canonical_ip
from alertloom.operators.contract import event_violations
from alertloom.schemas import RAW_ALERT, UNIFIED_EVENT

PAGE_SIZE = 100


def read_raw_alerts(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Raw alerts with the explicit schema; no inference pass over the data."""
    return spark.read.format(fmt).options(**options).schema(RAW_ALERT).load(path)


def stream_raw_alerts(spark: SparkSession, path: str, fmt: str = "json", max_files: int = 100, **options: str) -> DataFrame:
    return (spark.readStream.format(fmt).options(**options).option("maxFilesPerTrigger", max_files)
            .schema(RAW_ALERT).load(path))


def alert_page(alerts: DataFrame, after: tuple[datetime | str, str | int] | None = None,
               limit: int = PAGE_SIZE, ts: str = "timestamp", id_col: str = "id") -> DataFrame:
    """The next ``limit`` alerts in (time, id) order after a (time, id) position.

    Both parts of the position are kept, so a page neither repeats nor skips alerts that
    share an instant.  The time bound is also stated alone, for the scan to prune on.
    """
    if after is not None:
        at, last_id = F.lit(after[0]).cast(alerts.schema[ts].dataType), F.lit(after[1])
        alerts = alerts.where(
            (F.col(ts) >= at) & ((F.col(ts) > at) | (F.col(id_col) > last_id)))
    return alerts.orderBy(ts, id_col).limit(limit)


def checkpoint_position(events: DataFrame, ts: str = "timestamp", id_col: str = "event_id") -> DataFrame:
    """One row: the last (time, id) already written; nulls when the table is empty."""
    last = F.max(F.struct(F.col(ts).alias("ts"), F.col(id_col).alias("id")))
    return events.agg(last.alias("p")).select(F.col("p.ts").alias("last_ts"), F.col("p.id").alias("last_id"))


def events_to_bus(events: DataFrame) -> DataFrame:
    """Unified events as one JSON text column ``data``; absent values are left out."""
    from alertloom.operators.prompts import event_json
    return events.select(event_json(events).alias("data"))


def _typed(name: str, kind: T.DataType) -> tuple[Column, Column]:
    """A field of the parsed message ``_v`` in its column's type, and whether it has a type that does not convert.

    Text must be a JSON string.  A port may also be a whole number in a string or with zeros behind the point.
    """
    path, found = f"$.{name}", F.col(f"_kind_{name}")
    absent = found == "VOID"
    if name == "fields":
        return F.get_json_object("_raw", path), F.lit(False)  # judged by its own rules
    if isinstance(kind, T.ArrayType):
        fits = found.isin("ARRAY<STRING>", "ARRAY<VOID>")
        value = F.when(found == "ARRAY<STRING>", F.try_variant_get("_v", path, "array<string>")).when(
            fits & (F.get_json_object("_raw", path) == "[]"), F.array().cast("array<string>"))
        return value, ~absent & value.isNull()
    text = F.try_variant_get("_v", path, "string")
    if isinstance(kind, T.IntegerType):
        number = found.rlike("^(BIGINT|DECIMAL|DOUBLE)") | (found == "STRING")
        value = F.when(number & text.rlike(r"^\s*[+-]?\d+(?:\.0*)?\s*\z"), F.regexp_replace(F.trim(text), r"\.0*\z", "").try_cast("decimal(38,0)"))
        return value, ~absent & value.isNull()
    if name == "timestamp":
        return aware_timestamp(F.when(found == "STRING", text)), F.lit(False)  # an unreadable one has a rule of its own
    return F.when(found == "STRING", text), ~absent & (found != "STRING")


def events_from_bus(messages: DataFrame, data: str = "data") -> DataFrame:
    """Parses and validates bus messages; a malformed one is a row with violations, not a failure.

    Works on batch and streaming frames.  A field that is there but has the wrong JSON type is a violation
    (``<name>_type``) and reads as null; addresses are canonical; ``fields`` is kept as JSON text.
    """
    # Step by step, so that each value is found once and no generated method grows too large to compile.
    rows = computed_once(messages.select(F.col(data).alias("_raw")), "_raw", _v=F.try_parse_json("_raw"))
    rows = computed_once(rows, "_raw", "_v", **{f"_kind_{n}": F.coalesce(
        F.schema_of_variant(F.try_variant_get("_v", f"$.{n}", "variant")), F.lit("VOID")) for n in UNIFIED_EVENT.names})
    fields = {f.name: _typed(f.name, f.dataType) for f in UNIFIED_EVENT}
    known = F.array(*[F.lit(n) for n in UNIFIED_EVENT.names])
    keys = F.json_object_keys("_raw")
    extra = F.when(keys.isNull() | F.col("_v").isNull(), F.array(F.lit("not_json_object"))).when(
        F.size(F.array_except(keys, known)) > 0, F.array(F.lit("unknown_column"))).otherwise(
        F.array().cast("array<string>"))
    wrong = present(*[F.when(bad, F.lit(f"{n}_type")) for n, (_, bad) in fields.items()])
    rows = computed_once(rows, "_raw", **{n: v for n, (v, _) in fields.items()}, _also=F.concat(extra, wrong))
    for side in ("src_ip", "dst_ip"):
        rows = computed_once(rows, *[c for c in rows.columns if c != side], **{side: canonical_ip(F.col(side))})
    out = computed_once(rows, "_raw", *UNIFIED_EVENT.names, violations=F.concat(event_violations(), "_also"))
    ports = {p: F.when(F.col(p).between(0, 65535), F.col(p)).cast("int").alias(p) for p in ("src_port", "dst_port")}
    return out.select("_raw", *[ports.get(n, F.col(n)) for n in UNIFIED_EVENT.names], "violations")
