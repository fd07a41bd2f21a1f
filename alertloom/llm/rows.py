"""Helpers shared by the corpus operators."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own, so that extra or clashing columns cannot interfere.

    ``narrowed(docs, _id="doc_id", _text="text")``
    """
    return df.select(*(df[source].alias(name) for name, source in columns.items()))


def wrapped(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns beside ``_row``, the whole row as one struct, whose names clash with nothing."""
    return df.select(*(df[source].alias(name) for name, source in columns.items()),
                     F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))


def unwrapped(df: DataFrame, like: DataFrame, **changed) -> DataFrame:
    """The rows of a wrapped table in the columns of ``like``; ``changed`` replaces some of them."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in like.columns))


def fields(df: DataFrame, *more: StructField, keep: tuple[str, ...] = ("_id",)) -> StructType:
    return StructType([StructField(c, df.schema[c].dataType) for c in keep] + list(more))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    """A text column as UTF-8 bytes, without decoding it."""
    return column.cast(pa.large_binary()).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``: bounds what a task turns into Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_map(df: DataFrame, make: Callable, schema: StructType) -> DataFrame:
    """``mapInArrow`` for a function from record batches to column lists in the schema's order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)],
                schema=arrow)

    return df.mapInArrow(run, schema)


def hex64(column: str):
    """A long as sixteen lowercase hexadecimal digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
