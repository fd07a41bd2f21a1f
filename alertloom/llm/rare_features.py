"""Document fingerprints from statistically improbable features.

A feature is a window of 64 bytes.  Its entropy, in thousandths of the largest possible, is ranked by how rare that
value is among all windows of all documents: the rarest comes first.  In every run of 64 neighbouring windows the first
of the best rank gets a vote, and windows with at least 16 votes are selected.  Their hashes go, five bits each, into
Bloom filters of 2,048 bits, a new one after every 160 features; the chain of filters is the fingerprint.

Two fingerprints are compared filter by filter: shared bits beyond those that chance gives two filters so full, over
the most possible.  Each filter of the shorter chain counts with its best partner, weighted by its bits.

A text of few windows would have one feature or few, and its likeness would be all or nothing.  The features of texts of
up to 512 bytes are therefore all their 8-byte windows, and those of 384 bytes on have the selected 64-byte windows: between
the two a text has both, so that an edit that moves a text over a border leaves it features in common with what it was.
"""

import base64
import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced

WINDOW, RUN, VOTES = 64, 64, 16
STEPS = 1000                 # entropy values
WEAK = 100                   # windows below this entropy (nearly one byte repeated) are no features
BITS, HASHES, PER_FILTER = 2048, 5, 160
FINE_TO, FINE, COARSE_FROM = 512, 8, 384  # bytes: texts up to the first have windows of the second, from the third on of 64
_UNIT = 1 << 16
_C = np.arange(WINDOW + 1)
_SURPRISE = np.rint(_C * np.log2(np.maximum(_C, 1)) * _UNIT).astype(np.int64)  # c log2 c, in integers: sums stay exact
_STEP = np.diff(_SURPRISE, append=0)
_MOST = WINDOW * int(np.log2(WINDOW)) * _UNIT


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of every window of a byte array, 0 to ``STEPS``."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int32)
    after, before = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the next, the previous 63
    for gap in range(1, WINDOW):
        same = (data[:-gap] == data[gap:]).view(np.uint8)
        after[:-gap] += same
        before[gap:] += same
    first = _SURPRISE[np.bincount(data[:WINDOW], minlength=256)].sum()
    change = _STEP[before[WINDOW:]] - _STEP[after[:n - WINDOW]]
    total = np.empty(n - WINDOW + 1, np.int64)
    total[0] = first
    np.cumsum(change, out=total[1:])
    total[1:] += first
    return ((_MOST - total) * STEPS // _MOST).astype(np.int32)


def _joined(texts: list[bytes], most: int = 1 << 19):
    """Groups of texts of at most about ``most`` bytes (a longer one alone): (first index, starts, bytes)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= most):
            size += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[at:end]])
        yield at, np.concatenate([[0], np.cumsum(lengths)]), b"".join(texts[at:end])
        at = end


def _inside(starts: np.ndarray, n: int, width: int) -> np.ndarray:
    """Places from which ``width`` more bytes lie in the same text."""
    marks = np.zeros(n + 1, np.int32)
    ends = np.maximum(starts[1:] - width + 1, starts[:-1])
    np.add.at(marks, starts[:-1], 1)
    np.add.at(marks, ends, -1)
    return np.cumsum(marks[:-1]) > 0


def histogram(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(STEPS + 1, np.int64)
    for _, starts, data in _joined(texts):
        e = entropies(np.frombuffer(data, np.uint8))
        if len(e):
            counts += np.bincount(e[_inside(starts, len(data), WINDOW)[:len(e)]], minlength=STEPS + 1)
    return counts


def ranks_from(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy value, the rarest first; values never seen are the rarest."""
    order = np.lexsort((np.arange(STEPS + 1), counts))
    ranks = np.empty(STEPS + 1, np.int32)
    ranks[order] = np.arange(STEPS + 1)
    ranks[:WEAK] += STEPS + 1  # behind all others
    return ranks


def _selected(ranks: np.ndarray) -> np.ndarray:
    """Windows of one short text: those that one run over all of it would select."""
    return np.array([int(ranks.argmin())])


def features(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """Hashes of each text's features in order, each once.  A text under 8 bytes is one feature, an empty one has none."""
    out: list[np.ndarray] = []
    hashed = xxhash.xxh64_intdigest
    for at, starts, data in _joined(texts):
        n, e = len(data), entropies(np.frombuffer(data, np.uint8))
        chosen = np.zeros(0, np.int64)
        if len(e) >= RUN:
            rank = ranks[e].astype(np.int64)
            best = (rank << 40) | np.arange(len(e))
            step = 1
            while step < RUN:
                best = np.minimum(best[:-step], best[step:])
                step *= 2
            runs = _inside(starts, n, WINDOW + RUN - 1)[:len(best)]
            votes = np.bincount(best[runs] & ((1 << 40) - 1), minlength=len(e))
            chosen = np.flatnonzero((votes >= VOTES) & (e >= WEAK))
        cuts = np.searchsorted(chosen, starts)
        for i in range(len(starts) - 1):
            start, end = int(starts[i]), int(starts[i + 1])
            h: dict[int, None] = {}
            if 0 < end - start <= FINE_TO:
                h = dict.fromkeys(hashed(data[p:min(p + FINE, end)]) for p in range(start, max(start, end - FINE) + 1))
            if end - start >= COARSE_FROM:
                places = chosen[cuts[i]:cuts[i + 1]]
                if not len(places):
                    places = start + _selected(ranks[e[start:end - WINDOW + 1]])
                h |= dict.fromkeys(hashed(data[p:p + WINDOW]) for p in places.tolist())
            out.append(np.fromiter(h, np.uint64, len(h)))
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chain of Bloom filters, one row of bits-in-bytes each."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), np.uint8)
    which = np.arange(len(hashes)) // PER_FILTER
    bits = np.zeros((which[-1] + 1, BITS), bool)
    places = (hashes[:, None] >> (np.arange(HASHES, dtype=np.uint64) * np.uint64(11))) & np.uint64(BITS - 1)
    bits[np.repeat(which, HASHES), places.ravel().astype(np.int64)] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two empty chains are alike, an empty and another are not."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    if (len(a), np.bitwise_count(a).sum()) > (len(b), np.bitwise_count(b).sum()):
        a, b = b, a
    x, y = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    total = 0.0
    step = max(1, (1 << 16) // len(y))
    for i in range(0, len(x), step):
        shared = np.bitwise_count(x[i:i + step, None, :] & y[None]).sum(axis=2, dtype=np.int64)
        full = nx[i:i + step, None]
        chance = full * ny[None] / BITS
        alike = np.maximum(0.0, (shared - chance) / (np.minimum(full, ny[None]) - chance + 1e-12))
        total += float((alike.max(axis=1) * nx[i:i + step]).sum())
    return min(1.0, total / float(nx.sum()))


def encoded(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


# ---- Spark --------------------------------------------------------------------------------------------------------

def _histogram_columns(batches):
    counts = np.zeros(STEPS + 1, np.int64)
    for batch in sliced(batches, 256):
        counts += histogram([t or b"" for t in as_bytes(batch.column(0))])
    yield pa.array(np.arange(STEPS + 1, dtype=np.int32)), pa.array(counts)


def entropy_ranks(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Rarity ranks from all windows of all texts; ``STEPS + 1`` numbers reach the driver."""
    counts = arrow_map(docs.select(docs[text_col].alias("_text")), _histogram_columns, StructType([
        StructField("entropy", IntegerType()), StructField("windows", LongType())]))
    found = counts.groupBy("entropy").agg(F.sum("windows").alias("windows")).collect()
    total = np.zeros(STEPS + 1, np.int64)
    for row in found:
        total[row["entropy"]] = row["windows"]
    return ranks_from(total)


def fingerprints(docs: DataFrame, ranks: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, fingerprint)`` for every row; null texts count as empty, whose fingerprint is empty."""
    def run(batches):
        for batch in sliced(batches, 256):
            found = features([t or b"" for t in as_bytes(batch.column(1))], ranks)
            yield batch.column(0), [encoded(filters(h)) for h in found]

    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return arrow_map(rows, run, fields(rows, StructField("fingerprint", StringType()))).withColumnRenamed("_id", id_col)


def _place(bounds: list, value) -> int:
    """Which stretch of the id order a value lies in; nulls come first."""
    return 0 if value is None else bisect.bisect_right(bounds, value)


def _stretch_columns(bounds: list, firsts: dict):
    """Adds the stretch, and repeats the first row of each stretch behind the one before it."""
    import zstandard

    parts = sorted(firsts)
    before = {p: parts[i - 1] for i, p in enumerate(parts)}

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, 512):
            owner, part, tail = [], [], []
            for i, value in enumerate(batch.column(0).to_pylist()):
                p = _place(bounds, value)
                owner.append(i)
                part.append(p)
                tail.append(0)
                if value == firsts[p]:
                    owner.append(i)
                    part.append(before[p])
                    tail.append(1)
            packed = [packer.compress(t or b"") for t in as_bytes(batch.column(2))]
            rows = pa.array(owner, pa.int64())
            yield (pa.array(part, pa.int32()), pa.array(tail, pa.int32()), batch.column(0).take(rows),
                   batch.column(1).take(rows), pa.array([packed[i] for i in owner], pa.binary()))
    return run


def _edited(text: str, following: str) -> str:
    gone = len(text) // 4
    return text[:len(text) - gone] + following[:gone]


def _neighbour_columns(ranks: np.ndarray):
    """Reads stretches in order, each ending with the first row of the next one."""
    def run(batches):
        import zstandard

        unpacker, held = zstandard.ZstdDecompressor(), None
        for batch in sliced(batches, 128):
            rows = [] if held is None else [held]
            for i, (p, tail, packed) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 4)))):
                rows.append((p, tail, batch.column(2).slice(i, 1), unpacker.decompress(packed).decode("utf-8", "replace")))
            held = rows[-1]
            pairs = [i for i in range(len(rows) - 1) if not rows[i][1] and rows[i][0] == rows[i + 1][0]]
            if not pairs:
                continue
            edited = [_edited(rows[i][3], rows[i + 1][3]).encode() for i in pairs]
            texts = [r[3].encode() for r in rows] + edited
            chains = [filters(h) for h in features(texts, ranks)]
            own, other = chains[:len(rows)], chains[len(rows):]
            ids = pa.concat_arrays([rows[i][2] for i in pairs])
            yield (ids, [len(rows[i][3]) for i in pairs], [hashlib.sha256(e).hexdigest() for e in edited],
                   [encoded(own[i]) for i in pairs], [encoded(c) for c in other],
                   [likeness(own[i], c) for i, c in zip(pairs, other)], [likeness(own[i], own[i + 1]) for i in pairs])
    return run


def edit_report(docs: DataFrame, ranks: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text",
                stretches: int | None = None, sample: int = 10_000) -> DataFrame:
    """``(<id>, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` for every row.

    The edited text has its last quarter of code points replaced by the first as many of the next document's; next is
    by ascending id, nulls first, then by a hash of the text, and after the last comes the first.  A single row is
    its own next.  Null texts count as empty, repeated rows are neighbours, an empty table gives an empty result.  The id order is cut into stretches at ids from a sample of at most
    ``sample`` (it affects balance only); texts are shuffled once, compressed.
    """
    spark = docs.sparkSession
    if ranks is None:
        ranks = entropy_ranks(docs, text_col)
    ids = docs.select(docs[id_col].alias("_id"))
    total = ids.count()
    share = min(1.0, sample / max(1, total))
    # By a hash of the id, so that each task sends its share only; copies of an id meet before they are sent.
    chosen = ids.where("_id is not null").where(F.shiftrightunsigned(F.xxhash64("_id"), 33) < int(share * (1 << 31)))
    picked = sorted(r["_id"] for r in chosen.distinct().collect())
    wanted = 8 * (stretches or int(spark.conf.get("spark.sql.shuffle.partitions")))  # several a task even out their sizes
    bounds = picked[::max(1, len(picked) // wanted)][1:]

    def places(batches):
        for batch in batches:
            yield batch.column(0), pa.array([_place(bounds, v) for v in batch.column(0).to_pylist()], pa.int32())

    placed = arrow_map(ids, places, fields(ids, StructField("part", IntegerType())))
    firsts = {r["part"]: None if r["empty"] else r["low"] for r in placed.groupBy("part").agg(
        F.min("_id").alias("low"), F.max(F.col("_id").isNull()).alias("empty")).collect()}
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_hash"), docs[text_col].alias("_text"))
    cut = arrow_map(rows, _stretch_columns(bounds, firsts), StructType([
        StructField("_part", IntegerType()), StructField("_tail", IntegerType()), rows.schema["_id"], rows.schema["_hash"],
        StructField("_packed", BinaryType())]))
    sorted_ = cut.repartition(max(1, -(-len(bounds) // 8)), "_part").sortWithinPartitions("_part", "_tail", "_id", "_hash")
    text, score = StringType(), DoubleType()
    return arrow_map(sorted_, _neighbour_columns(ranks), StructType([
        StructField(id_col, rows.schema["_id"].dataType), StructField("n_chars", LongType()), StructField("edited_sha256", text),
        StructField("fingerprint", text), StructField("edited_fingerprint", text), StructField("near_edited", score),
        StructField("near_next", score)]))
