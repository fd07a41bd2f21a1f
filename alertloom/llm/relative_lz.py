"""Substring dedup by window hashing over indexed blocks of all earlier documents, in place of relative Lempel-Ziv parsing.

The words of each document are covered by *blocks*.  Of the eight-word grams in a window of ``window`` words, the one
with the smallest hash is the window's anchor; the windows of one anchor are neighbours, and their words together are
its block (up to 91 words for windows of 50).  Equal windows have equal anchors, whatever surrounds them, so all
places where a window may occur again lie in blocks with the same anchor.  Every document's blocks form the reference,
indexed by anchor, each with the smallest id it occurs under.

A document's blocks are compared with the reference.  An anchor that has one block everywhere needs one comparison: the
whole block is found.  An anchor with several blocks (at an edit, or where a shared passage meets different
neighbours) is resolved window by window over its distinct blocks.  The windows found, also across block boundaries,
are united, and the words of each union become a duplicate span.  No longest match is grown and no factor is stored: what
is removed is the words of all windows that an earlier document has, which the union gives without parsing.

Nothing is keyed by document: a passage in a third of all documents is one block after map-side aggregation.  Grams,
blocks and windows are compared by independent 64-bit hashes, two of them for each decision.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced, unwrapped, wrapped
from alertloom.session import stage

GRAM = 8
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
KEPT_POWERS = 1 << 15


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; as many as usual texts need are kept, more are made for a long text alone."""
    if base in _powers and n <= KEPT_POWERS:
        return _powers[base][:n]
    steps = np.full(max(n, KEPT_POWERS), base, np.uint64)
    steps[0] = 1
    powers = np.cumprod(steps, dtype=np.uint64)
    _powers.setdefault(base, powers[:KEPT_POWERS].copy())
    return powers[:n]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Hashes of runs of a text's words."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        self.hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.hashes * _power(_BASE, self.n), out=self.sums[1:])

    def run(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * _power(_INVERSE, self.n + 1)[start])

    def blocks(self, window: int) -> tuple[np.ndarray, ...]:
        """Per block: anchor hash, block hash, first window, number of windows."""
        gram = min(GRAM, window)
        at = np.arange(self.n - gram + 1)
        grams, width, windows = self.run(at, at + gram), window - gram + 1, self.n - window + 1
        anchors = np.empty(windows, np.int64)
        view = np.lib.stride_tricks.sliding_window_view(grams, width)
        for i in range(0, windows, 1 << 14):
            anchors[i:i + (1 << 14)] = view[i:i + (1 << 14)].argmin(axis=1)
        anchors += np.arange(windows)
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        count = np.diff(np.append(first, windows))
        anchor = anchors[first]
        shape = ((anchor - first) << 32 | count).astype(np.uint64)
        return grams[anchor], _mixed(self.run(first, first + count + window - 1) + _mixed(shape)), first, count


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _block_columns(window: int):
    def run(batches):
        for batch in sliced(batches, 256):
            owner, found = [], []
            for i, text in enumerate(as_bytes(batch.column(2))):
                words = text.split() if text else []
                if len(words) >= window:
                    found.append(Words(words).blocks(window))
                    owner.append(np.full(len(found[-1][0]), i))
            if found:
                rows = pa.array(np.concatenate(owner))
                anchor, block, first, count = map(np.concatenate, zip(*found))
                yield (batch.column(0).take(rows), batch.column(1).take(rows), _signed(anchor), _signed(block),
                       pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)))
    return run


def _window_columns(window: int):
    """Reads (_id, _key, _text, blocks); gives each block's windows."""
    def run(batches):
        for batch in sliced(batches, 256):
            owner, anchors, blocks, offsets, hashes = [], [], [], [], []
            for i, (text, wanted) in enumerate(zip(as_bytes(batch.column(2)), batch.column(3).to_pylist())):
                words = Words(text.split())
                for b in wanted:
                    start = np.arange(b["first"], b["first"] + b["count"])
                    hashes.append(words.run(start, start + window))
                    offsets.append(np.arange(b["count"], dtype=np.int32))
                    anchors += [b["anchor"]] * b["count"]
                    blocks += [b["block"]] * b["count"]
                    owner += [i] * b["count"]
            if owner:
                yield (batch.column(0).take(pa.array(owner)), anchors, blocks, pa.array(np.concatenate(offsets)),
                       _signed(np.concatenate(hashes)))
    return run


_KEY = ("_id", "_key")
_INT, _LONG = IntegerType(), LongType()
BROADCAST_ROWS = 1_000_000


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_text``, the whole ``_row``, and ``_key``, which with the id names a row (equal rows are alike)."""
    return wrapped(docs, _id=id_col, _text=text_col).withColumn("_key", F.xxhash64("_id", "_text"))


def duplicate_spans(rows: DataFrame, window: int = 50) -> DataFrame:
    """``(_id, _key, spans)`` for rows with words covered by a window that also starts under a smaller id.

    ``rows`` has ``_id, _key, _text``.  ``spans`` lists runs of such windows as (first window, number of windows),
    at most one entry per block and window of the row.  A null id is not smaller than any id: rows without one
    neither lend nor lose words.
    """
    texts = rows.where("_id is not null and _text is not null").select("_id", "_key", "_text")
    blocks = stage(arrow_map(texts, _block_columns(window), fields(
        texts, StructField("anchor", _LONG), StructField("block", _LONG), StructField("first", _INT),
        StructField("count", _INT), keep=_KEY)), "blocks")
    anchors = blocks.groupBy("anchor").agg(
        F.min("_id").alias("lowest"), F.max("_id").alias("highest"), F.min("block").alias("b0"), F.max("block").alias("b1"))
    # Written, as all joins of rows with totals here: a join of two plain scans is one that a hot key can be split in.
    shared_anchors = stage(anchors.where("lowest < highest").select(
        "anchor", "lowest", (F.col("b0") != F.col("b1")).alias("several")), "shared-anchors")
    shared = stage(blocks.join(shared_anchors, "anchor"), "shared-blocks")

    plain = shared.where("not several and lowest < _id").select(*_KEY, "first", "count")
    several = shared.where("several").drop("lowest", "several")
    reference = several.groupBy("anchor", "block").agg(F.min("_id").alias("_id"))
    places = several.join(reference, ["anchor", "block", "_id"]).dropDuplicates(["anchor", "block"])
    wanted = stage(places.groupBy(*_KEY).agg(F.collect_list(F.struct("anchor", "block", "first", "count")).alias("blocks")),
                   "reference-blocks")
    bounded = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    names = wanted.select(*_KEY)
    held = texts.join(F.broadcast(names) if bounded else names, list(_KEY), "left_semi").dropDuplicates(list(_KEY))
    sources = held.join(wanted, list(_KEY)).select(*_KEY, "_text", "blocks")
    windows = stage(arrow_map(sources, _window_columns(window), fields(
        sources, StructField("anchor", _LONG), StructField("block", _LONG), StructField("offset", _INT),
        StructField("hash", _LONG), keep=("_id",))), "reference-windows")
    lowest = windows.groupBy("anchor", "hash").agg(F.min("_id").alias("lowest"), F.max("_id").alias("highest"))
    held_by = several.groupBy("anchor", "block").agg(F.max("_id").alias("last"))
    # A block is only looked at again if one of its windows starts under an id below the largest id it occurs under.
    known = stage(windows.join(lowest, ["anchor", "hash"]).groupBy("anchor", "block").agg(
        F.collect_list(F.struct("offset", "lowest")).alias("windows"), F.min("lowest").alias("lowest")).join(
        held_by, ["anchor", "block"]).where("lowest < last").select("anchor", "block", "windows"), "known-blocks")
    resolved = several.join(known, ["anchor", "block"]).select(
        *_KEY, "first", F.filter("windows", lambda w: w["lowest"] < F.col("_id")).alias("windows")).where(
        "size(windows) > 0").select(*_KEY, F.explode(F.transform("windows", lambda w: F.struct(
            (F.col("first") + w["offset"]).alias("first"), F.lit(1).alias("count")))).alias("w")).select(
        *_KEY, "w.first", "w.count")
    return plain.union(resolved).groupBy(*_KEY).agg(F.collect_list(F.struct("first", "count")).alias("spans"))


def cut(text: bytes | None, spans: list[dict] | None, window: int) -> tuple[int, int, list[bytes], list[bytes]]:
    """Number of words, number removed, the kept words and all words."""
    words = text.split() if text else []
    if spans is None or not len(spans):
        return len(words), 0, words, words
    marks = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        marks[span["first"]] += 1
        marks[span["first"] + span["count"] + window - 1] -= 1
    covered = np.cumsum(marks[:-1]) > 0
    kept = [words[i] for i in np.flatnonzero(~covered)]
    return len(words), int(covered.sum()), kept, words


def _digest_columns(window: int):
    def run(batches):
        for batch in sliced(batches, 256):
            cuts = [cut(t, s, window) for t, s in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist())]
            yield (batch.column(0), [c[0] for c in cuts], [c[1] for c in cuts],
                   [b" ".join(c[2]) for c in cuts])
    return run


def _spanned(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    spans = duplicate_spans(rows, window).select(F.col("_id").alias("_sid"), F.col("_key").alias("_skey"), "spans")
    return rows.join(spans, F.expr("_id = _sid and _key = _skey"), "left")


def repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """``(<id>, n_words, n_removed, kept)`` for every row, ``kept`` being the UTF-8 of the words left, joined by spaces.

    Words are stretches without ASCII white space.  A word goes if some run of ``window`` words around it also starts
    in a row with a smaller id; this is judged on the input, not on what is left.  Null and empty texts have no
    words; texts of fewer words than a window lose none.  Repeats inside one id do not count, repeated rows lose the
    same words each.  An empty table gives an empty result.
    """
    rows = _spanned(docs, id_col, text_col, window).select("_id", "_text", "spans")
    out = arrow_map(rows, _digest_columns(window), fields(
        rows, StructField("n_words", _LONG), StructField("n_removed", _LONG), StructField("kept", BinaryType())))
    return out.withColumnRenamed("_id", id_col)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50,
                    length_col: str | None = "n_chars") -> DataFrame:
    """The rows with repeated words taken out of their text, and the length column, if there is one, set anew.

    A text that loses nothing stays as it is, white space included.  A row that had words and has none left goes.  Null
    and empty texts and rows without an id stay as they are, repeated rows lose the same words each; an empty table
    gives an empty result.
    """
    rows = arrow_map(_spanned(docs, id_col, text_col, window).select("_row", "_text", "spans"), _kept_columns(window), StructType([
        StructField("_row", docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")).schema["_row"].dataType),
        StructField("_kept", StringType()), StructField("_cut", BooleanType())]))
    changed = {text_col: F.col("_kept")}
    if length_col in docs.columns:
        changed[length_col] = F.when(F.col("_cut"), F.length("_kept").cast(docs.schema[length_col].dataType)).otherwise(
            F.col(f"_row.`{length_col}`"))
    return unwrapped(rows, docs, **changed)


def _kept_columns(window: int):
    """Reads (_row, _text, spans); leaves out rows of which nothing is left."""
    def run(batches):
        for batch in sliced(batches, 256):
            texts, cut_any, stay = as_bytes(batch.column(1)), [], []
            for i, spans in enumerate(batch.column(2).to_pylist()):
                if spans is not None:
                    texts[i] = b" ".join(cut(texts[i], spans, window)[2])
                cut_any.append(spans is not None)
                stay.append(spans is None or texts[i] != b"")
            stay = pa.array(stay, pa.bool_())
            yield (batch.column(0).filter(stay), pa.array(texts, pa.binary()).cast(pa.string()).filter(stay),
                   pa.array(cut_any, pa.bool_()).filter(stay))
    return run
