"""Distinct values over the last 24 hours from mergeable sketches, where exact counting would keep every value.

Sketches are made per (key, ten-minute slot), so a stream stores one of bounded size per slot and never the values.  The
window [t - 24 h, t) of an event is its own slot up to t, the whole slots before, and the end of the slot in which the
window begins; the union of the three is estimated.  Both ends are sketches of rows, so the window is not widened to slots.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import MICROS, cell_of, micros
from alertloom.operators.history import DAY_S, SLOT_S, _host_key, _net_key

LG_K = 12  # relative standard error about 1.04 / sqrt(2**LG_K)


def _keyed(rows: DataFrame, value: str) -> DataFrame:
    """(key, us, value) of history rows: under their source, and a network alert under its sensor too."""
    src, sensor = F.col("src_ip"), F.col("sensor")
    keys = F.array_compact(F.array(F.coalesce(_net_key(src), _host_key(sensor)), F.when(src.isNotNull(), _host_key(sensor))))
    return rows.select(F.explode(keys).alias("key"), micros("timestamp").alias("us"), F.col(value).cast("string").alias("value"))


def slot_sketches(history: DataFrame, value: str = "rule_id", slot_s: int = SLOT_S, lg_k: int = LG_K) -> DataFrame:
    """``(key, slot, sketch)``: nulls do not count.  Sketches of disjoint stretches of history merge by union."""
    rows = _keyed(history, value).withColumn("slot", cell_of(F.col("us"), slot_s * MICROS))
    return rows.groupBy("key", "slot").agg(F.hll_sketch_agg("value", F.lit(lg_k)).alias("sketch"))


def approx_distinct_24h(events: DataFrame, history: DataFrame, value: str = "rule_id", slot_s: int = SLOT_S,
                        lg_k: int = LG_K) -> DataFrame:
    """``(event_id, approx_distinct)``: estimated distinct values of the event's key in the 24 hours before it.

    Keys and window are those of the exact counts.  Event ids are taken to be distinct.
    """
    slot_us, day_us = slot_s * MICROS, DAY_S * MICROS
    if day_us % slot_us:
        raise ValueError("slot_s must divide a day")
    rows = _keyed(history, value).withColumn("slot", cell_of(F.col("us"), slot_us))
    asking = events.select("event_id", F.coalesce(_net_key(F.col("src_ip")), _host_key(F.col("sensor"))).alias("key"), micros("timestamp").alias("us"))
    nothing = F.lit(None).cast("string")

    def ends(shift_us: int, frame: Window) -> DataFrame:
        probes = asking.select("key", (F.col("us") - shift_us).alias("us"), nothing.alias("value"), cell_of(F.col("us") - shift_us, slot_us).alias("slot"), "event_id")
        both = rows.withColumn("event_id", nothing).unionByName(probes)
        found = both.select("event_id", F.hll_sketch_agg("value", F.lit(lg_k)).over(frame).alias("sketch"))
        return found.where("event_id is not null")

    in_slot = Window.partitionBy("key", "slot")
    head = ends(0, in_slot.orderBy("us").rangeBetween(Window.unboundedPreceding, -1))
    tail = ends(day_us, in_slot.orderBy(-F.col("us")).rangeBetween(Window.unboundedPreceding, 0))
    # Whole slots between: one sketch per slot of a key, a number that time bounds.
    whole = slot_sketches(history, value, slot_s, lg_k)
    asked = asking.select("key", cell_of(F.col("us"), slot_us).alias("slot")).distinct()
    by_slot = Window.partitionBy("key").orderBy("slot").rangeBetween(1 - day_us // slot_us, -1)
    between = asked.join(whole, ["key", "slot"], "full").select(
        "key", "slot", F.hll_union_agg("sketch").over(by_slot).alias("sketch"))
    middle = asking.select("event_id", "key", cell_of(F.col("us"), slot_us).alias("slot")).join(between, ["key", "slot"]).select("event_id", "sketch")
    united = head.unionByName(tail).unionByName(middle).groupBy("event_id").agg(F.hll_union_agg("sketch").alias("sketch"))
    return united.select("event_id", F.coalesce(F.hll_sketch_estimate("sketch"), F.lit(0)).alias("approx_distinct"))
