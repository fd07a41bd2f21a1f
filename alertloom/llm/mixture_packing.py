"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of documents in a seeded order.  Every window of ``length`` ids credits each queue its share of
the window; the queue serves whole ids up to its credit, cutting a document where the credit ends, and the fraction left
is carried on.  After w windows a queue has served the rounded sum of its credits, so a window is off its target by less
than one id (``grain`` ids) per source.  A queue that runs dry leaves its share to the others from there on.

The credit after w windows is a function of w that only needs the queues' totals: with time measured so that a queue
serves its weight per unit, the ids served by all queues are a sum of lines that end where queues run dry, and its
inverse gives the time at which a window is full.  So a document knows its windows and cuts from its place in its queue
alone, no loop runs over windows, and credits carry over windows and partitions by construction.  The order (window,
source, place in the queue) is laid out on one line of ids and cut every ``length`` ids, so only the last sequence can be
short.  Both running sums have two levels: totals of buckets, then sums inside a bucket.
"""

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from alertloom.llm.rows import arrow_map, sliced
from alertloom.llm.tokens import END_ID, WORD_TOKENIZER, token_table
from alertloom.session import stage

_LONG = LongType()
REST = "*"  # the queue of all sources without one of their own
LEAST_ROWS = 2_000


def _bucket_rows(rows: int) -> int:
    """Rows of a bucket, so that the rows of one and the number of all grow alike, with the root of a table's size."""
    return max(LEAST_ROWS, math.isqrt(rows))


@dataclass(frozen=True)
class Schedule:
    """Ids that queues have served after so many windows."""

    totals: np.ndarray   # ids by queue
    weights: np.ndarray
    length: int
    grain: int = 1

    def __post_init__(self):
        dry = self.totals / self.weights
        order = np.argsort(dry, kind="stable")
        times = np.concatenate([[0.0], dry[order]])
        rates = self.weights.sum() - np.concatenate([[0.0], np.cumsum(self.weights[order])])
        rates[-1] = 0.0
        served = np.concatenate([[0.0], np.cumsum(np.diff(times) * rates[:-1])])
        object.__setattr__(self, "_line", (times, served, np.where(rates > 0, rates, np.inf)))

    def credit(self, queue: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Whole ids of a queue served before a window: never less for a later one, all of them at the end."""
        times, served, rates = self._line
        full = windows.astype(float) * self.length
        at = np.clip(np.searchsorted(served, full, side="right") - 1, 0, len(times) - 1)
        time = times[at] + (full - served[at]) / rates[at]
        ids = np.floor(self.weights[queue] * time / self.grain + 0.5).astype(np.int64) * self.grain
        return np.where(full >= served[-1] - 0.5, self.totals[queue], np.minimum(ids, self.totals[queue]))

    def window(self, queue: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The window that serves a queue's id at a place."""
        times, served, rates = self._line
        time = place / self.weights[queue]
        at = np.clip(np.searchsorted(times, time, side="right") - 1, 0, len(times) - 1)
        line = served[at] + np.where(np.isinf(rates[at]), 0.0, (time - times[at]) * np.where(np.isinf(rates[at]), 0.0, rates[at]))
        w = np.maximum((line // self.length).astype(np.int64), 0)
        while (behind := self.credit(queue, w + 1) <= place).any():  # rounding moves a place by a window or two
            w = w + behind
        while (ahead := (w > 0) & (self.credit(queue, w) > place)).any():
            w = w - ahead
        return w


def queues_of(totals: DataFrame, weights: dict[str | None, float] | None, temper: float, queues: int) -> list[tuple[str, int, float]]:
    """``(source, ids, weight)`` per queue; ``totals`` has (_source, n).

    Sources named in ``weights`` have queues of their own, all others share one with the least weight.  Without weights
    the ``queues`` sources with the most ids have their own, of weight ids ** ``temper``, the others share one.
    """
    if weights is not None:
        if any(not w > 0 for w in weights.values()):
            raise ValueError("weights must be positive; leave a source's rows out instead of giving it none")
        named = {_queue_name(s): float(w) for s, w in weights.items()}
        own = totals.where(F.col("_source").isin(list(named))) if named else totals.limit(0)
    else:
        own = totals.orderBy(F.desc("n"), "_source").limit(queues)
    found = [(r["_source"], int(r["n"])) for r in own.collect()]
    everything = totals.agg(F.sum("n")).first()[0] or 0
    if rest := int(everything) - sum(n for _, n in found):
        found.append((REST, rest))
    if weights is not None:
        least = min(named.values(), default=1.0)
        return sorted((s, n, named.get(s, least)) for s, n in found)
    return sorted((s, n, float(n) ** temper) for s, n in found)


def _queue_name(source: str | None) -> str:
    return "" if source is None else f"={source}"


def _cut_columns(schedule: Schedule):
    """Reads (_row, queue, n, first); one row per window that a document has ids in."""
    def run(batches):
        for batch in sliced(batches, 8192):
            row, queue, n, first = (batch.column(i).to_numpy() for i in range(4))
            low, high = schedule.window(queue, first), schedule.window(queue, first + n - 1)
            count = high - low + 1
            of = np.repeat(np.arange(len(row)), count)
            window = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
            start = np.maximum(schedule.credit(queue[of], window), first[of])
            end = np.minimum(schedule.credit(queue[of], window + 1), first[of] + n[of])
            held = end > start  # a window in which the queue serves nothing
            yield (pa.array(row[of][held]), pa.array((start - first[of])[held]), pa.array((end - start)[held]),
                   pa.array(window[held]), pa.array(queue[of][held]), pa.array(start[held]))
    return run


def placements(lengths: DataFrame, length: int, grain: int = 1, weights: dict | None = None, temper: float = 1.0,
               queues: int = 1024) -> DataFrame:
    """``(_row, start, n, at)`` per piece: ids ``start`` to ``start + n`` of a row lie at ``at`` on the line.

    ``lengths`` has ``(_row, _source, n)`` with distinct ``_row``.  Queues are cut into buckets and the line into parts, so
    that a source with a third of all rows is many partitions; the only tables summed in a single task have a row per
    bucket or part, as many as the root of the number of rows.
    """
    sizes = lengths.groupBy("_source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    totals = stage(sizes, "queue-totals")
    found = queues_of(totals.select("_source", "n"), weights, temper, queues)
    if not found:
        return lengths.select("_row", F.lit(0).cast("long").alias("start"), "n", F.lit(0).cast("long").alias("at"))
    rows = totals.agg(F.sum("rows")).first()[0]
    schedule = Schedule(np.array([n for _, n, _ in found], np.int64), np.array([w for *_, w in found], float), length, grain)
    spark = lengths.sparkSession
    numbers = spark.createDataFrame([(s, q) for q, (s, *_) in enumerate(found)], "_name string, queue long")
    rest = next((q for q, (s, *_) in enumerate(found) if s == REST), None)
    queued = lengths.join(F.broadcast(numbers), F.col("_source") == F.col("_name"), "left").select(  # ``queues`` rows at most
        "_row", F.coalesce("queue", F.lit(rest).cast("long")).alias("queue"), "n", F.xxhash64("_row").alias("_order"))
    buckets = math.ceil(rows / _bucket_rows(rows))
    seeded = queued.withColumn("_bucket", F.pmod(F.shiftright("_order", 20), F.lit(buckets)))
    sums = seeded.groupBy("queue", "_bucket").agg(F.sum("n").alias("_n"))
    before = sums.select("queue", "_bucket", (
        F.sum("_n").over(Window.partitionBy("queue").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    inside = Window.partitionBy("queue", "_bucket").orderBy("_order", "_row")
    placed = seeded.join(before, ["queue", "_bucket"]).select(
        "_row", "queue", "n", (F.col("_before") + F.sum("n").over(inside) - F.col("n")).alias("first"))
    pieces = arrow_map(placed, _cut_columns(schedule), StructType([
        StructField(c, _LONG) for c in ("_row", "start", "n", "window", "queue", "place")]))
    windows = math.ceil(sum(n for _, n, _ in found) / length)
    most = rows + windows * min(len(found), length)  # pieces
    wide = math.ceil(windows * _bucket_rows(most) / most)  # windows in a part
    segments = stage(pieces.withColumn("_part", F.floor(F.col("window") / wide)), "segments")
    per_part = segments.groupBy("_part").agg(F.sum("n").alias("ids"))
    base = per_part.select("_part", (F.sum("ids").over(Window.orderBy("_part")) - F.col("ids")).alias("_base"))
    turn = Window.partitionBy("_part").orderBy("window", "queue", "place")
    return segments.join(base, "_part").select(
        "_row", "start", "n", (F.col("_base") + F.sum("n").over(turn) - F.col("n")).alias("at"))


def _piece_columns(length: int, width: int, with_ids: bool):
    """Reads (_id, ids, n, spots); joins neighbouring segments, cuts at sequence ends, and slices the ids."""
    def run(batches):
        for batch in sliced(batches, 512):
            counts = pc.list_value_length(batch.column(3)).to_numpy()
            start, n, at = (c.to_numpy() for c in pc.list_flatten(batch.column(3)).flatten())
            owner = np.repeat(np.arange(len(counts)), counts)
            order = np.lexsort((start, owner))
            owner, start, n, at = owner[order], start[order], n[order], at[order]
            apart = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + n[:-1]) | (at[1:] != at[:-1] + n[:-1])
            first = np.flatnonzero(np.concatenate([[True], apart]))
            n, owner, start, at = np.add.reduceat(n, first), owner[first], start[first], at[first]
            cuts = (at + n - 1) // length - at // length + 1
            of = np.repeat(np.arange(len(n)), cuts)
            sequence = at[of] // length + np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            low, high = np.maximum(at[of], sequence * length), np.minimum((at + n)[of], (sequence + 1) * length)
            doc, from_, size = owner[of], start[of] + low - at[of], high - low
            wide = [np.frombuffer(i, f"<u{width}").astype("<u4").tobytes() for i in batch.column(1).to_pylist()]
            pieces = [wide[d][4 * s:4 * e] for d, s, e in zip(doc.tolist(), from_.tolist(), (from_ + size).tolist())]
            doc = pa.array(doc)
            out = [batch.column(0).take(doc), pa.array(from_), pa.array(size), list(map(zlib.crc32, pieces)),
                   batch.column(2).take(doc), pa.array(sequence), pa.array(low - sequence * length)]
            yield *out, *([pieces] if with_ids else [])
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         length: int = 2048, grain: int = 1, weights: dict | None = None, temper: float = 1.0, queues: int = 1024,
         tokenizer: str = WORD_TOKENIZER, end: int | None = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``<id>, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and ``ids`` (unsigned
    32-bit little-endian).

    ``weights`` are target proportions by source; sources not named share one queue with the least of them.  Without
    weights a source's target is its number of ids to the power ``temper`` (1: every window repeats the corpus mix; less
    lifts small sources until they run dry), for the ``queues`` largest sources, the others sharing a queue.  With more
    than some hundred sources a larger ``grain`` keeps pieces from becoming single ids.  Every id lies in exactly one
    piece, pieces lie without gaps from 0 in each sequence, and only the last sequence is short.  Null texts are empty
    (only the end id); with ``end=None`` empty texts have no piece.  Rows with a null source are a queue of their own,
    null and repeated ids are packed row by row.  An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("")).alias("_source"),
                       F.monotonically_increasing_id().alias("_row"), docs[text_col].alias("_text"))
    tokens = stage(token_table(rows, ("_id", "_source", "_row"), tokenizer=tokenizer, end=end).where("n > 0"), "tokens")
    spots = placements(tokens.select("_row", "_source", "n"), length, grain, weights, temper, queues).groupBy("_row").agg(
        F.collect_list(F.struct("start", "n", "at")).alias("spots"))
    width = 2 if tokenizer == WORD_TOKENIZER else _width(tokenizer)
    joined = tokens.select("_row", "_id", "ids", "n").join(spots, "_row").select("_id", "ids", "n", "spots")
    schema = StructType([StructField(id_col, docs.schema[id_col].dataType)] + [
        StructField(c, _LONG) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + (
        [StructField("ids", BinaryType())] if with_ids else []))
    return arrow_map(joined, _piece_columns(length, width, with_ids), schema)


def _width(tokenizer: str) -> int:
    from alertloom.llm.tokens import WordTokens, tokenizer_path

    return WordTokens(tokenizer_path(tokenizer)).dtype.itemsize


def sequences(pieces: DataFrame, length: int = 2048, pad: int = 0) -> DataFrame:
    """Whole sequences from the pieces of :func:`pack`: ``sequence_id, n_tokens, ids`` padded to ``length``."""
    grouped = pieces.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    body = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    padding = F.unhex(F.repeat(F.lit(np.array([pad], "<u4").tobytes().hex()), (F.lit(length) - F.col("n_tokens")).cast("int")))
    return grouped.select("sequence_id", "n_tokens", F.concat(body, padding).alias("ids"))
