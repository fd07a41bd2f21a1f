"""Notification outbox, system-health notices and their coalescing."""

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertloom.functions.columns import MICROS, cell_of, micros
from alertloom.schemas import NOTIFICATION, SYSTEM_NOTICE, require_exactly
from alertloom.session import stage

WINDOW_S = 60
BLOCK_S = 3600
FAN = 32
_NONE = -(2**62)  # the start before a key's first window


def project_notifications(decided: DataFrame) -> DataFrame:
    """The closed list of columns that may leave the system, for rows that notify."""
    degraded = F.col("context.lookup_degraded")
    flags = F.when(degraded, F.concat("flags", F.array(F.lit("context_degraded")))).otherwise(F.col("flags"))
    ctx = ["src_ip_seen_before", "related_events_24h", "distinct_rules_from_src_24h",
           "events_last_10min", "src_in_allowlist", "matched_rule"]
    source = {c: F.col(f"context.{c}") for c in ctx} | {"flags": flags}
    out = decided.where("should_notify").select(
        *[source.get(n, F.col(n)).alias(n) for n in NOTIFICATION.names])
    return require_exactly(out, NOTIFICATION, "notification")


def _notice(df: DataFrame, kind: str, at: str, **cols) -> DataFrame:
    base = {"sensor": F.col("sensor"), "severity": F.col("severity_hint") if "severity_hint" in df.columns
            else F.col("severity"), "reason": F.lit(kind), "retry_count": F.lit(None).cast("int"),
            "detail": F.lit(None).cast("string")} | cols
    return df.select(F.lit(kind).alias("kind"), *[base[n].alias(n) for n in SYSTEM_NOTICE.names[1:]],
                     F.col(at).cast("timestamp").alias("at"))


def dead_letter_notices(dead: DataFrame, at: str = "dead_lettered_at") -> DataFrame:
    return _notice(dead, "dead_letter", at, severity=F.col("severity"), reason=F.col("reason"),
                   retry_count=F.col("retry_count"), detail=F.col("detail"))


def degradation_notices(events: DataFrame, at: str = "timestamp") -> DataFrame:
    """``events`` are rows whose context look-ups failed."""
    return _notice(events, "enrichment_degraded", at)


def age_notices(events: DataFrame, at: str = "timestamp") -> DataFrame:
    """``events`` are rows suppressed for their age."""
    return _notice(events, "age_suppressed", at)


def system_notices(dead: DataFrame, degraded: DataFrame, aged: DataFrame) -> DataFrame:
    return dead_letter_notices(dead).unionByName(degradation_notices(degraded)).unionByName(age_notices(aged))


# ---------------------------------------------------------------------------
# Coalescing.  Per key the first notice fires with count 1 and opens a window; the
# first notice at least ``window_s`` after the window's start fires the number of
# notices in the closed window and opens the next.  Where a window starts depends on
# the one before, so a key is a chain.  It is cut into blocks of time: every block is
# a step function from the chain's last window start before it to the last one in it.
# Runs of ``FAN`` neighbouring blocks compose their functions into one, level by level
# up to one function a key; on the way down every run hands each of its blocks the
# start that reaches it.  Then the blocks list their fires in parallel.  No task ever
# follows more than ``FAN`` blocks of a key, however many notices the key has.
# ---------------------------------------------------------------------------


def _successors(t: np.ndarray, window_us: int) -> np.ndarray:
    return np.searchsorted(t, t + window_us, side="left")


def _entry_exit(t: np.ndarray, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """Last anchor of the chain for every distinct outcome, with the latest entry that has it."""
    n = len(t)
    jump = np.append(_successors(t, window_us), n)
    # The open window started no later than the block's first notice, so the chain enters
    # at most one window after that notice, or at the first notice beyond.
    edge = t[0] + window_us
    entries = np.arange(min(int(np.searchsorted(t, edge, side="left")) + 1, n))
    at = entries.copy()
    while True:
        ahead = jump[at]
        moving = ahead < n
        if not moving.any():
            break
        at = np.where(moving, ahead, at)
    last_of_run = np.append(at[1:] != at[:-1], True)
    return t[entries[last_of_run]], t[at[last_of_run]]


def _applied(start: np.ndarray, upto: np.ndarray, leave: np.ndarray, window_us: int) -> np.ndarray:
    """The last window start behind a block, for starts before it; a block the windows reach over changes nothing."""
    at = np.searchsorted(upto, start + window_us, side="left")
    return np.where(at < len(upto), np.append(leave, _NONE)[at], start)


def _composed(blocks: list[tuple[np.ndarray, np.ndarray]], first: int, window_us: int) -> tuple[np.ndarray, np.ndarray]:
    """One step function for neighbouring blocks.  The start before them is no later than their first notice."""
    upto, leave = blocks[0]
    for more_upto, more_leave in blocks[1:]:
        leave = _applied(leave, more_upto, more_leave, window_us)
        if upto[-1] < first + window_us:
            beyond = more_upto > upto[-1]
            upto, leave = np.append(upto, more_upto[beyond]), np.append(leave, more_leave[beyond])
    last_of_run = np.append(leave[1:] != leave[:-1], True)
    upto, leave = upto[last_of_run], leave[last_of_run]
    needed = int(np.searchsorted(upto, first + window_us, side="left")) + 1
    return upto[:needed], leave[:needed]


def _windows(t: np.ndarray, entry: int, window_us: int) -> list[dict]:
    """The windows a block opens (start, notices in the block), after one for the notices before."""
    after = _successors(t, window_us)
    i = int(np.searchsorted(t, entry, side="left"))
    starts = []
    while i < len(t):
        starts.append(i)
        i = int(after[i])
    bounds = [0, *starts, len(t)]
    return [{"at": int(t[lo]) if n else None, "size": hi - lo}
            for n, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]


_STEP = ["k", "block", "first", "upto", "exit"]
_STEP_SCHEMA = "k string, block bigint, first bigint, upto bigint, exit bigint"


def _by_block(batches: Iterator[pd.DataFrame], *cols: str, block: str = "block") -> Iterator[tuple]:
    """(k, block, arrays of ``cols``) per block from rows sorted by (k, block), across batches."""
    by = block
    name, held = None, []
    for pdf in batches:
        if pdf.empty:
            continue
        k, block = pdf["k"].to_numpy(), pdf[by].to_numpy()
        arrays = [pdf[c].to_numpy() for c in cols]
        starts = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (block[1:] != block[:-1])))
        for lo, hi in zip(starts, [*starts[1:], len(k)]):
            if (k[lo], block[lo]) != name:
                if held:
                    yield (*name, *map(np.concatenate, zip(*held)))
                name, held = (k[lo], block[lo]), []
            held.append([a[lo:hi] for a in arrays])
    if held:
        yield (*name, *map(np.concatenate, zip(*held)))


def _batched(rows: Iterator[tuple], columns: list[str], size: int = 10_000) -> Iterator[pd.DataFrame]:
    while chunk := list(islice(rows, size)):
        yield pd.DataFrame(chunk, columns=columns)


def coalesce_notices(notices: DataFrame, key: list[str] | None = None, at: str = "at",
                     window_s: int = WINDOW_S, block_s: int = BLOCK_S,
                     open_windows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(fired, still_open).

    ``fired`` (key..., fired_at, count): the notices that go out and how many each stands
    for.  ``still_open`` (key..., opened_at, count): windows not closed yet, which are not
    reported; pass them as ``open_windows`` to continue with later notices.
    """
    key = key or ["reason", "sensor"]
    if block_s < window_s:
        raise ValueError("block_s must be at least window_s")
    window_us, block_us = window_s * MICROS, block_s * MICROS

    def outcomes_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for k, block, t in _by_block(batches, "us"):
                for upto, leave in zip(*_entry_exit(t, window_us)):
                    yield k, block, int(t[0]), int(upto), int(leave)

        return _batched(rows(), _STEP)

    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One function for each run of blocks: rows (k, run, block, first, upto, exit)."""
        def rows():
            for k, run, block, first, upto, leave in _by_block(batches, "block", "first", "upto", "exit", block="run"):
                cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
                parts = list(zip(np.split(upto, cuts), np.split(leave, cuts)))
                for u, x in zip(*_composed(parts, int(first[0]), window_us)):
                    yield k, run, int(first[0]), int(u), int(x)

        return _batched(rows(), _STEP)

    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The start before each block of a run.  A run's first row, if it has no threshold, holds the start before it."""
        def rows():
            for k, run, block, upto, leave in _by_block(batches, "block", "upto", "exit", block="run"):
                start = np.array([_NONE])
                if block[0] < 0:
                    start, block, upto, leave = leave[:1], block[1:], upto[1:], leave[1:]
                cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
                for b, u, x in zip(np.split(block, cuts), np.split(upto, cuts), np.split(leave, cuts)):
                    if len(b):
                        yield k, int(b[0]), int(start[0]), bool(u[-1] >= start[0] + window_us)
                        start = _applied(start, u, x, window_us)

        return _batched(rows(), ["k", "block", "start", "enters"])

    def windows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks start with their entry, if the chain enters them; else all belongs to the open window."""
        def rows():
            for k, block, us, is_entry in _by_block(batches, "us", "is_entry"):
                if is_entry[0]:
                    yield k, block, _windows(us[1:], int(us[0]), window_us)
                else:
                    yield k, block, [{"at": None, "size": len(us)}]

        return _batched(rows(), ["k", "block", "w"])

    def packed(df: DataFrame):
        return F.to_json(F.struct(*[df[c] for c in key]), {"ignoreNullFields": "false"}).alias("k")

    rows = notices.select(packed(notices), micros(at).alias("us"))
    if open_windows is not None:
        # A late notice counts towards the open window, as if it came at the window's start.
        starts = open_windows.select(packed(open_windows), micros("opened_at").alias("_start"))
        rows = rows.join(starts, "k", "left").select("k", F.greatest("us", "_start").alias("us"))
    rows = rows.withColumn("block", cell_of(F.col("us"), block_us))
    steps = stage(
        rows.repartition("k", "block").sortWithinPartitions("k", "block", "us").mapInPandas(outcomes_of, _STEP_SCHEMA),
        "notice-steps")
    lowest, highest = steps.agg(F.min("block"), F.max("block")).first()
    lowest, span = lowest or 0, (highest or 0) - (lowest or 0)
    before_all_value = -(2**40)
    before_all = F.lit(before_all_value).alias("block")
    opened = None
    if open_windows is not None:
        opened = open_windows.select(packed(open_windows), before_all, micros("opened_at").alias("upto"), "count")
    # Up: levels of runs, counted from the lowest block, until one run can hold all that are left.
    run = F.floor(F.col("block") / FAN).alias("run")
    levels = [steps.withColumn("block", F.col("block") - lowest)]
    while span >= FAN:
        span //= FAN
        levels.append(stage(
            levels[-1].select("*", run).repartition("k", "run").sortWithinPartitions("k", "run", "block", "upto")
            .mapInPandas(up, _STEP_SCHEMA), "notice-steps"))
    # Down: the start before a key's only run is that of its open window, if it has one.
    starts = steps.select("k", F.lit(0).cast("long").alias("block")).distinct()
    if opened is not None:
        starts = starts.join(opened.select("k", F.col("upto").alias("start")), "k", "left").withColumn(
            "start", F.coalesce("start", F.lit(_NONE)))
    else:
        starts = starts.withColumn("start", F.lit(_NONE))
    for level in reversed(levels):
        given = starts.select("k", F.col("block").alias("run"), F.lit(-1).cast("long").alias("block"),
                              F.lit(_NONE).alias("upto"), F.col("start").alias("exit"))
        below = given.unionByName(level.select("k", run, "block", "upto", "exit"))
        starts = below.repartition("k", "run").sortWithinPartitions("k", "run", "block", "upto").mapInPandas(
            down, "k string, block bigint, start bigint, enters boolean")
    entries = starts.where("enters").select("k", (F.col("block") + lowest).alias("block"), (
        F.when(F.col("start") == _NONE, F.col("start")).otherwise(F.col("start") + window_us)).alias("entry"))
    marked = rows.withColumn("is_entry", F.lit(False)).unionByName(
        entries.select("k", "block", F.col("entry").alias("us"), F.lit(True).alias("is_entry")))
    per_block = (
        marked.repartition("k", "block").sortWithinPartitions("k", "block", F.desc("is_entry"), "us")
        .mapInPandas(windows_of, "k string, block bigint, w array<struct<at:bigint,size:bigint>>")
    ).where(F.col("block") > before_all_value)
    if open_windows is not None:
        held = F.array(F.struct(F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("size")),
                       F.struct(F.col("upto").alias("at"), F.col("count").alias("size")))
        per_block = per_block.unionByName(opened.select("k", "block", held.alias("w")))
    # The notice that closes a window counts the tail of the block that opened it, the
    # blocks the chain passed over since, and its own block's head.  A key's blocks meet
    # by three numbers each; their windows stay where they are and are joined to them.
    per_block = stage(per_block, "notice-blocks")
    by_block = Window.partitionBy("k").orderBy("block")
    slim = per_block.select("k", "block", (F.size("w") > 1).alias("opens"), F.col("w")[0]["size"].alias("head"),
                            F.element_at("w", -1)["size"].alias("tail"))
    slim = slim.withColumn("_group", F.count_if("opens").over(by_block.rowsBetween(Window.unboundedPreceding, 0)))
    slim = slim.withColumn("_open", F.sum("tail").over(Window.partitionBy("k", "_group"))).where("opens")
    slim = slim.select(
        "k", "block", "_open", F.coalesce(F.lag("_open").over(by_block) + F.col("head"), F.lit(1).cast("long")).alias("closing"),
        F.lead("block").over(by_block).isNull().alias("_last"))
    started = F.slice(F.col("w"), F.lit(2), F.size("w") - 1)
    grouped = per_block.join(slim, ["k", "block"]).select(
        "k", "block", started.alias("w"), "_open",
        F.concat(F.array("closing"), F.transform(started, lambda x: x["size"])).alias("n"), "_last")
    schema = notices.select(*key).schema

    def unpacked(df: DataFrame, *cols) -> DataFrame:
        return df.withColumn("_k", F.from_json("k", schema)).select(
            *[F.col(f"_k.{c}").alias(c) for c in key], *cols)

    told = F.transform("w", lambda x, i: F.struct(x["at"].alias("us"), F.get("n", i).alias("n")))
    fired = unpacked(
        grouped.where(F.col("block") != before_all).select("k", F.explode(told).alias("z")),
        F.timestamp_micros("z.us").alias("fired_at"), F.col("z.n").alias("count"))
    still_open = unpacked(
        grouped.where("_last"), F.timestamp_micros(F.element_at("w", -1)["at"]).alias("opened_at"),
        F.col("_open").alias("count"))
    return fired, still_open


def fan_out(df: DataFrame, payloads: dict) -> DataFrame:
    """One outbox row per notification and channel; no channels, no rows.

    ``payloads`` maps channel name to its rendered text column.
    """
    pairs = [F.struct(F.lit(name).alias("channel"), text.alias("payload")) for name, text in payloads.items()]
    empty = F.array().cast("array<struct<channel:string,payload:string>>")
    return df.select("*", F.inline(F.array(*pairs) if pairs else empty))
