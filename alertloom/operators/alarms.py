"""Threshold alarms over fixed periods."""

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import MICROS, micros

_COMPARE = {">": operator.gt, ">=": operator.ge}
_STATISTIC = {"max": F.max, "avg": F.avg}


@dataclass(frozen=True)
class Alarm:
    """Breaches when ``statistic`` of a period compares to ``threshold``, ``periods`` times running.

    ``missing``: a period without samples is ``not_breaching``, or is ``missing`` and
    leaves the state as it was.
    """

    name: str
    metric: str
    statistic: str
    comparison: str
    threshold: float
    periods: int
    missing: str
    period_s: int = 300


# Thresholds and period counts of the host alarms.
INSTANCE_DOWN = Alarm("instance-status-check-failed", "StatusCheckFailed", "max", ">", 0, 2, "not_breaching")
DISK_FULL = Alarm("data-disk-used-percent", "disk_used_percent", "avg", ">=", 85, 2, "missing")
GPU_BUSY = Alarm("gpu-utilization-high", "nvidia_smi_utilization_gpu", "avg", ">=", 95, 6, "missing")
GPU_MEMORY = Alarm("gpu-memory-high", "nvidia_smi_memory_used", "avg", ">=", 22528, 6, "missing")


def evaluate_alarm(samples: DataFrame, alarm: Alarm, by: list[str], ts: str = "ts",
                   value: str = "value") -> DataFrame:
    """(by..., period_start, statistic, breaching, in_alarm), a row per period with samples.

    Samples fold into periods on the map side; what is ordered afterwards is one row per
    series and period.  Periods without samples produce no row: with ``not_breaching``
    they break a run, with ``missing`` a run continues over them.
    """
    period = F.window(F.col(ts).cast("timestamp"), f"{alarm.period_s} seconds")["start"]
    stat = samples.groupBy(*by, period.alias("period_start")).agg(
        _STATISTIC[alarm.statistic](value).alias("statistic"))
    stat = stat.withColumn("breaching", _COMPARE[alarm.comparison](F.col("statistic"), F.lit(alarm.threshold)))
    stat = stat.withColumn("_no", (micros("period_start") / F.lit(alarm.period_s * MICROS)).cast("long"))
    series = Window.partitionBy(*by).orderBy("_no")
    back = alarm.periods - 1
    last = series.rowsBetween(-back, 0) if alarm.missing == "missing" else series.rangeBetween(-back, 0)
    run = F.min(F.col("breaching").cast("int")).over(last)
    enough = F.count("*").over(last) == alarm.periods
    return stat.select(*by, "period_start", "statistic", "breaching", ((run == 1) & enough).alias("in_alarm"))


def any_alarm(evaluated: list[DataFrame], by: list[str]) -> DataFrame:
    """Composite OR: a period is in alarm when any of the base alarms is."""
    rows = [e.select(*by, "period_start", "in_alarm") for e in evaluated]
    return reduce(DataFrame.unionByName, rows).groupBy(*by, "period_start").agg(
        F.bool_or("in_alarm").alias("in_alarm"))
