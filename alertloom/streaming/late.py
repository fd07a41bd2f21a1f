"""Rows that come behind the watermark: kept and counted beside the stream, where Spark's own operators drop them.

The watermark of a batch is the latest event time of all earlier batches less ``delay_s``, as for ``withWatermark``, and
a row is late if its time is not after it.  Rows on time go on; late ones are written with the watermark they missed.
Every batch owns its folders, and the one row of state it leaves behind is a version of its own, so a batch that dies
half-way replays with the same watermark and overwrites what it wrote.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from alertloom.functions.columns import MICROS, micros
from alertloom.session import remove
from alertloom.streaming.ingest import POLL, _start, batch_dir

CLOCK = "latest_ms long"


@dataclass
class LateSplit:
    """Tables under ``root``: ``on_time`` and ``late``, by batch, and ``clock``, the last two versions of the state.

    ``late`` has ``watermark`` and ``late_by_s`` beside the row; a row without a time is late, by null.
    """

    root: str
    delay_s: int = 600
    ts: str = "timestamp"

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = False, poll: str = POLL) -> StreamingQuery:
        return _start(events, self.process, checkpoint, available_now, poll)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = self._latest(spark, batch_id)
        batch = batch.persist()
        try:
            mark = F.lit(None if before is None else before * 1000 - self.delay_s * MICROS).cast("long")
            at = micros(self.ts)
            late = F.coalesce(at <= mark, F.col(self.ts).isNull())
            batch.where(~late).write.mode("overwrite").parquet(batch_dir(f"{self.root}/on_time", batch_id))
            batch.where(late).withColumns({"watermark": F.timestamp_micros(mark), "late_by_s": (mark - at) / MICROS}).write.mode(
                "overwrite").parquet(batch_dir(f"{self.root}/late", batch_id))
            latest = batch.agg(F.floor(F.max(at) / 1000)).first()[0]
        finally:
            batch.unpersist()
        known = [t for t in (before, latest) if t is not None]
        spark.createDataFrame([(max(known),)] if known else [], CLOCK).coalesce(1).write.mode("overwrite").parquet(
            batch_dir(f"{self.root}/clock", batch_id))
        remove(spark, batch_dir(f"{self.root}/clock", batch_id - 2))

    def _latest(self, spark: SparkSession, batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        row = spark.read.schema(CLOCK).parquet(batch_dir(f"{self.root}/clock", batch_id - 1)).first()
        return None if row is None else row["latest_ms"]

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")


def late_counts(late: DataFrame, *by: str) -> DataFrame:
    """``(batch_id, by..., late_rows, most_late_s)`` of a ``late`` table."""
    return late.groupBy("batch_id", *by).agg(F.count("*").alias("late_rows"), F.max("late_by_s").alias("most_late_s"))
