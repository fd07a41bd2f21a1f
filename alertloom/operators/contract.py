"""Boundary validation of unified events and the quarantine split."""

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertloom.functions.columns import computed_once, present
from alertloom.functions.net import is_ip
from alertloom.schemas import REQUIRED_EVENT_COLUMNS, SCHEMA_VERSION

FIELDS_MAX_BYTES = 4096


@F.pandas_udf(T.IntegerType())
def fields_bytes(texts: pd.Series) -> pd.Series:
    """Size of a JSON object re-serialized with ASCII escapes and spaced separators; -1 if not one."""
    def size(text):
        if text is None:
            return None
        try:
            value = json.loads(text)
        except ValueError:
            return -1
        return len(json.dumps(value)) if isinstance(value, dict) else -1
    return texts.map(size).astype("Int32")


def _doubtful_fields() -> Column:
    """``fields`` where only its size once escaped can tell; null for JSON objects that are too short to be too large.

    A character costs six bytes at most for each of its 16-bit units, and separators a byte more.
    """
    text = F.col("fields")
    is_object = F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT")
    short = F.length(text) * 12 <= FIELDS_MAX_BYTES
    return F.when(~F.coalesce(short & is_object, F.lit(False)), text)


def _named(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def event_violations(check_fields: bool = True, *also: Column) -> Column:
    """Array of broken rules, with ``also`` names of a source's own rules.

    ``check_fields`` needs Python; skip it where no source sets fields.
    """
    rules = [
        _named(F.col(c).isNull(), f"{c}_missing")
        for c in REQUIRED_EVENT_COLUMNS if c not in ("timestamp", "schema_version", "summary")
    ]
    rules += [
        _named(F.col("timestamp").isNull(), "timestamp_invalid"),
        _named(~F.col("schema_version").eqNullSafe(SCHEMA_VERSION), "schema_version_unknown"),
        _named(~F.coalesce(F.length("summary").between(1, 500), F.lit(False)), "summary_length"),
    ]
    for side in ("src", "dst"):
        rules.append(_named(F.col(f"{side}_ip").isNotNull() & ~is_ip(F.col(f"{side}_ip")), f"{side}_ip_invalid"))
        rules.append(_named(~F.col(f"{side}_port").between(0, 65535), f"{side}_port_range"))
    if check_fields:
        size = fields_bytes(_doubtful_fields())
        rules.append(_named(size < 0, "fields_not_object"))
        rules.append(_named(size > FIELDS_MAX_BYTES, "fields_too_large"))
    return present(*rules, *also)


def validate_events(df: DataFrame, check_fields: bool = True) -> DataFrame:
    """Adds ``violations`` to a frame that already has the unified columns."""
    return computed_once(df, *df.columns, violations=event_violations(check_fields))


def split_quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, quarantine): the quarantine keeps the id and the broken rules, never alert text."""
    ok = F.size("violations") == 0
    events = df.where(ok).drop("violations")
    quarantine = df.where(~ok).select("event_id", "source_module", "violations")
    return events, quarantine
