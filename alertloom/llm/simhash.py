"""SimHash near-duplicates: fingerprints linked through nearby Golay codewords.

A fingerprint's 64 bits are cut into three segments of 22, 21 and 21 bits, each read as a word of the perfect binary
Golay code (23, 12, 7).  A word's *near codewords* are what it and its one-bit neighbours decode to: one codeword, or
six.  Two words at most two bits apart share a near codeword (the word halfway lies one bit from both), and two words
at most one bit apart have the decoding of either among the near codewords of the other.

Of four differing bits, the three segments get e1 <= e2 <= e3 with e1 + e2 <= 2, so one of these holds:

* two segments differ by at most one bit each: they meet under (decoded i, near j) against (near i, decoded j);
* one segment is equal and the other two differ by two bits each: they meet under (equal i, near j).

Those are about 45 keys per distinct fingerprint, of 24 bits and more.  Keys only propose pairs; each is verified by
its bit distance.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from alertloom.llm.components import components
from alertloom.llm.rows import arrow_map, as_bytes, fields, narrowed, sliced, unwrapped, wrapped
from alertloom.session import stage

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
MAX_BITS = 4
BROADCAST_ROWS = 10_000
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the binary Golay code (fixed value)
GENERATOR = 0xC75


# ---- fingerprints -------------------------------------------------------------------------------------------------

def fingerprint(text: bytes | None, shingle: int = 4) -> int:
    """The unsigned 64-bit fingerprint of a UTF-8 text; 0 for a text without words."""
    words = text.lower().split() if text else []  # of bytes: folds A-Z only, splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths).tolist(), ends[shingle - 1:].tolist()
    del words
    total, counts, hashed = len(ends), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, total, 1 << 15):
        part = slice(at, at + (1 << 15))
        hashes = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts[part], ends[part])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > total).astype(np.uint64)
    return int((bits << np.arange(64, dtype=np.uint64)).sum(dtype=np.uint64))


def _fingerprint_columns(shingle: int):
    def run(batches):
        for batch in sliced(batches, 512):
            prints = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield batch.column(0), pa.array(prints.view(np.int64))
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``(_id, fp)`` for every row."""
    df = narrowed(docs, _id=id_col, _text=text_col)
    return arrow_map(df, _fingerprint_columns(shingle), fields(df, StructField("fp", LongType())))


# ---- Golay keys ---------------------------------------------------------------------------------------------------

def _syndrome(words: np.ndarray) -> np.ndarray:
    left = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        left ^= ((left >> np.uint32(bit)) & np.uint32(1)) * np.uint32(GENERATOR << (bit - 11))
    return left


def _errors_by_syndrome() -> np.ndarray:
    """For each of the 2,048 syndromes, the one error pattern of at most three bits."""
    single = 1 << np.arange(23)
    i, j = np.triu_indices(23, 1)
    pairs = single[i] | single[j]
    triples = [int(p) | (1 << k) for p, top in zip(pairs, j) for k in range(top + 1, 23)]
    errors = np.array([0, *single, *pairs, *triples], np.uint32)
    table = np.zeros(2048, np.uint32)
    table[_syndrome(errors)] = errors
    return table


class Golay:
    """Decoding of 23-bit words to 12-bit codeword indices."""

    def __init__(self):
        self.errors = _errors_by_syndrome()
        self.flips = (1 << np.arange(23)).astype(np.uint32)
        self.flip_syndromes = _syndrome(self.flips)

    def decoded(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.errors[_syndrome(words)]) >> np.uint32(11)

    def near(self, words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Near codewords within one flip of the lowest ``width`` bits, sorted per row, and which of them are new."""
        syndromes = _syndrome(words)[:, None] ^ np.concatenate([[np.uint32(0)], self.flip_syndromes[:width]])[None, :]
        flipped = words[:, None] ^ np.concatenate([[np.uint32(0)], self.flips[:width]])[None, :]
        found = np.sort((flipped ^ self.errors[syndromes]) >> np.uint32(11), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return found, new


def golay_keys(prints: np.ndarray, code: Golay) -> tuple[np.ndarray, np.ndarray]:
    """All ``(key, position in prints)`` of some fingerprints; a print has each key once."""
    parts = [((prints >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.uint32) for at, width in SEGMENTS]
    decoded = [code.decoded(p).astype(np.int64) for p in parts]
    near = [code.near(p, width) for p, (_, width) in zip(parts, SEGMENTS)]
    keys, rows = [], []

    def add(kind: int, fixed: np.ndarray, side: tuple[np.ndarray, np.ndarray], high_fixed: bool, skip=None):
        found, new = side
        if skip is not None:
            new = new & (found != skip[:, None])
        row, _ = np.nonzero(new)
        many, one = found[new].astype(np.int64), fixed[row].astype(np.int64)
        keys.append((np.int64(kind) << 40) | ((one << 12 | many) if high_fixed else (many << 12 | one)))
        rows.append(row)

    for kind, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        add(kind, decoded[i], near[j], True)
        add(kind, decoded[j], near[i], False, skip=decoded[i])
    for i in range(3):
        add(3 + i, parts[i], near[(i + 1) % 3], True)
    return np.concatenate(keys), np.concatenate(rows)


def _key_columns(batches):
    code = Golay()
    for batch in sliced(batches, 8192):
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        keys, rows = golay_keys(prints, code)
        yield pa.array(keys), pa.array(prints[rows].view(np.int64))


# ---- verified links -----------------------------------------------------------------------------------------------

class Forest:
    """Union-find over linked fingerprints; tells which links are new.  Forgetting it only repeats links."""

    def __init__(self, most: int = 400_000):
        self.parent: dict[int, int] = {}
        self.most = most

    def root(self, x: int) -> int:
        parent = self.parent
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, top)
        return top

    def joins(self, x: int, y: int) -> bool:
        if len(self.parent) > self.most:
            self.parent.clear()
        a, b = self.root(x), self.root(y)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        self.parent.setdefault(min(a, b), min(a, b))
        return True


def _spanning(prints: np.ndarray, bits: int):
    """Links of a spanning forest of the prints at most ``bits`` apart: breadth first, each print left once."""
    open_ = prints
    while len(open_) > 1:
        frontier, open_ = open_[:1], open_[1:]
        while len(frontier) and len(open_):
            step = max(1, (1 << 21) // len(open_))
            now, frontier = frontier[:step], frontier[step:]
            close = np.bitwise_count(now[:, None] ^ open_[None, :]) <= bits
            reached = close.any(axis=0)
            if reached.any():
                yield from zip(now[close[:, reached].argmax(axis=0)].tolist(), open_[reached].tolist())
                frontier = np.concatenate([frontier, open_[reached]])
                open_ = open_[~reached]


SMALL_RUN = 16


def _run_links(keys: np.ndarray, prints: np.ndarray, bits: int, forest: Forest):
    """Links within the runs of equal keys that connect prints the task has not connected yet."""
    if len(keys) < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = np.repeat((sizes > 1) & (sizes <= SMALL_RUN), sizes)
    k, p = keys[small], prints[small]
    for gap in range(1, min(SMALL_RUN, len(k))):
        same = k[gap:] == k[:-gap]
        if not same.any():
            break
        left, right = p[:-gap][same], p[gap:][same]
        close = np.bitwise_count(left ^ right) <= bits
        for x, y in zip(left[close].tolist(), right[close].tolist()):
            if forest.joins(x, y):
                yield x, y
    for n in np.flatnonzero(sizes > SMALL_RUN):
        run = prints[starts[n]:starts[n] + sizes[n]]
        if len({forest.root(x) for x in run.tolist()}) > 1:
            for x, y in _spanning(run, bits):
                if forest.joins(x, y):
                    yield x, y


def _link_columns(bits: int, most: int):
    """Reads (key, fp) sorted by key.  Runs over ``most`` prints are passed on in blocks, to be compared in pairs."""
    def out(links=(), hot=None):
        if hot is None:
            pairs = np.array(list(links), np.uint64).reshape(-1, 2).view(np.int64)
            n = len(pairs)
            return pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())
        key, block, prints = hot
        n = len(prints)
        return (pa.array(prints.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)),
                pa.array(np.full(n, block, np.int32)))

    def run(batches):
        forest = Forest()
        k, p, block = np.empty(0, np.int64), np.empty(0, np.uint64), 0
        for batch in batches:
            k = np.concatenate([k, batch.column(0).to_numpy(zero_copy_only=False)])
            p = np.concatenate([p, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            first = np.searchsorted(k, k[-1]) if len(k) else 0
            if first and block:  # the large run that was being passed on ends here
                end = np.searchsorted(k, k[0], side="right")
                yield out(hot=(k[0], block, p[:end]))
                k, p, first, block = k[end:], p[end:], first - end, 0
            if first:
                yield out(_run_links(k[:first], p[:first], bits, forest))
                k, p = k[first:], p[first:]
            while len(k) > most:
                yield out(hot=(k[0], block, p[:most]))
                k, p, block = k[most:], p[most:], block + 1
        if len(k):
            yield out(hot=(k[0], block, p)) if block else out(_run_links(k, p, bits, forest))
    return run


def _block_pair_columns(bits: int):
    """Reads (key, x, y, fp) grouped by (key, x, y): one pair of blocks of a large run at a time."""
    def run(batches):
        forest, last, held = Forest(), None, []

        def links():
            prints = np.unique(np.concatenate(held)) if held else np.empty(0, np.uint64)
            pairs = [xy for xy in _spanning(prints, bits) if forest.joins(*xy)]
            both = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.array(both[:, 0]), pa.array(both[:, 1])

        for batch in batches:
            group = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], 1)
            prints = batch.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            cuts = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            for at, end in zip([0, *cuts], [*cuts, len(prints)]):
                if end > at:
                    if last is not None and tuple(group[at]) != last:
                        yield links()
                        held = []
                    last = tuple(group[at])
                    held.append(prints[at:end])
        if held:
            yield links()
    return run


def links(prints: DataFrame, bits: int = MAX_BITS, most: int = 65_536) -> DataFrame:
    """``(a, b)``: enough links between distinct fingerprints (column ``fp``) to connect all that are linked.

    Every pair at most ``bits`` apart is proposed by some key; a task reports a pair unless its reported links
    connect the two already.  A key with more than ``most`` prints is cut into blocks, compared pair by pair of
    blocks in tasks of their own, so no task holds more than two blocks.
    """
    if not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the key scheme is complete for at most {MAX_BITS} bits")
    long = LongType()
    keys = arrow_map(prints.select("fp").distinct(), _key_columns,
                     StructType([StructField("key", long), StructField("fp", long)]))
    found = stage(arrow_map(
        keys.repartition("key").sortWithinPartitions("key", "fp"), _link_columns(bits, most),
        StructType([StructField("a", long), StructField("b", long), StructField("key", long),
                    StructField("block", IntegerType())])), "simhash-links")
    hot = found.where("key is not null").select("key", "block", F.col("a").alias("fp"))
    blocks = hot.groupBy("key").agg(F.max("block").alias("last"))
    pairs = hot.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0), "last"))).select(
        "key", F.least("block", "other").cast("long").alias("x"), F.greatest("block", "other").cast("long").alias("y"), "fp")
    across = arrow_map(
        pairs.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y"), _block_pair_columns(bits),
        StructType([StructField("a", long), StructField("b", long)]))
    return found.where("key is null").select("a", "b").union(across)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                    bits: int = MAX_BITS) -> DataFrame:
    """``(<id>, fp, component_id, root)`` for every row.

    ``fp`` is the row's fingerprint, ``root`` the smallest fingerprint of its component and ``component_id`` the
    smallest id in it.  Copies share a fingerprint and are folded before anything is linked.  Null and empty texts
    have fingerprint 0 and link like any other.  Rows with a null id are kept and belong to a component but never
    name it (``component_id`` is null if no row of it has an id).  Repeated rows are repeated in the result.
    An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("_id").alias("first"))
    roots = components(links(prints, bits))
    low = roots.join(distinct.withColumnRenamed("fp", "node"), "node").groupBy("root").agg(F.min("first").alias("low"))
    grouped = roots.join(low, "root").select(F.col("node").alias("fp"), "low", "root")
    # Written, so that rows meet a plain table: that join can split a fingerprint that very many rows share.
    classes = stage(distinct.join(grouped, "fp", "left").select(
        "fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id"),
        F.coalesce("root", "fp").alias("root")), "simhash-components")
    return prints.join(classes, "fp").select(F.col("_id").alias(id_col), "fp", "component_id", "root")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4,
                         bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of near-duplicates, with all its columns: the one with the smallest id.

    Rows without an id come last.  Among rows that share id and fingerprint, the one with the smallest text stays.
    """
    classes = stage(near_duplicates(docs, id_col, text_col, shingle, bits).select(
        F.col(id_col).alias("_id"), F.col("fp").alias("_fp"), F.col("root").alias("_root")), "simhash-classes")
    order = F.struct(F.col("_id").isNull(), "_id", "_fp")
    chosen = classes.groupBy("_root").agg(F.min(order).alias("c")).select("c._id", "c._fp")
    # Ids that several rows share, or no id: only there does it take the fingerprint to tell the chosen row.
    shared = classes.groupBy("_id").count().where("count > 1 or _id is null").select(F.col("_id").alias("_sid"))
    chosen = chosen.select(F.col("_id").alias("_cid"), F.col("_fp").alias("_cfp"))
    whole = wrapped(docs, _id=id_col, _text=text_col)
    alone = chosen.where("_cid is not null").join(shared, F.col("_cid") == F.col("_sid"), "left_anti")
    plain = whole.join(alone, F.col("_id") == F.col("_cid"), "left_semi")
    few = F.broadcast(shared) if shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else shared
    doubtful = whole.join(few, F.col("_id").eqNullSafe(F.col("_sid")), "left_semi").select("_id", "_text", "_row")
    printed = arrow_map(doubtful, _carry_row(shingle), fields(
        doubtful, StructField("_fp", LongType()), keep=("_id", "_text", "_row")))
    once = printed.groupBy("_id", "_fp").agg(F.min_by("_row", F.coalesce("_text", F.lit(""))).alias("_row"))
    kept = once.join(chosen, F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("_fp") == F.col("_cfp")), "left_semi")
    return unwrapped(plain, docs).unionByName(unwrapped(kept, docs))


def _carry_row(shingle: int):
    def run(batches):
        for batch in sliced(batches, 512):
            prints = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield *batch.columns, pa.array(prints.view(np.int64))
    return run
