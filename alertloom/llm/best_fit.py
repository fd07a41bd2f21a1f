"""Token-id output: documents packed by best-fit decreasing.

Documents become token ids; one longer than a sequence is split into whole sequences and a rest, losing nothing.
Pieces are sorted by length, longest first, and each goes to the open sequence with the least room that still holds it.
A segment tree over capacities finds that room in as many steps as it has levels.

Each task packs its own pieces, ``group_ids`` ids at a time, so there is no exchange and memory is bounded; sequences
of one group are nearly all full, as pieces of all lengths are at hand.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from alertloom.llm.rows import arrow_map, as_bytes, sliced
from alertloom.llm.tokens import END_ID, WORD_TOKENIZER, tokenizer_path, word_tokens


class CapacityTree:
    """Bins by the room they have left; answers which room, at least as large as asked, is the smallest in use."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.used = [0] * (2 * self.leaves)          # number of bins below a node
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def _count(self, room: int, step: int) -> None:
        node = room + self.leaves
        while node:
            self.used[node] += step
            node >>= 1

    def put(self, bin_: int, room: int) -> None:
        self.bins[room].append(bin_)
        self._count(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room for ``size`` and that room; None if no bin has it."""
        node = size + self.leaves
        if not self.used[node]:
            while node > 1 and (node & 1 or not self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not self.used[node]:
                    node += 1
        room = node - self.leaves
        self._count(room, -1)
        return self.bins[room].pop(), room


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers, for pieces of 1 to ``capacity``."""
    tree, bins = CapacityTree(capacity), []
    for piece in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[piece])
        if found is None:
            bins.append([])
            found = len(bins) - 1, capacity
        bin_, room = found
        bins[bin_].append(piece)
        if room > sizes[piece]:
            tree.put(bin_, room - sizes[piece])
    return bins


def _columns(length: int, tokenizer: str, end: int | None, pad: int, group_ids: int):
    def run(batches):
        words = word_tokens(tokenizer_path(tokenizer))
        width, task, made = words.dtype.itemsize, TaskContext.get().partitionId(), 0
        pieces: list[tuple[pa.Array, int, bytes]] = []  # id, first token in its document, ids

        def packed():
            nonlocal made
            bins = best_fit_decreasing([len(p[2]) // width for p in pieces], length)
            if not bins:
                return
            order = np.array([i for b in bins for i in b])
            ids = pa.concat_arrays([pieces[i][0] for i in order])
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bins])]).astype(np.int32))
            starts = pa.array([pieces[i][1] for i in order], pa.int64())
            rows, lengths, resets = [], [], []
            for b in bins:
                sizes = [len(pieces[i][2]) // width for i in b]
                row = np.full(length, pad, words.dtype)
                row[:sum(sizes)] = np.frombuffer(b"".join(pieces[i][2] for i in b), words.dtype)
                place = np.zeros(length, words.dtype)
                place[:sum(sizes)] = np.concatenate([np.arange(n) for n in sizes])
                rows.append(row.tobytes())
                resets.append(place.tobytes())
                lengths.append(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            numbers = [(task << 40) | (made + i) for i in range(len(bins))]
            made += len(bins)
            pieces.clear()
            for at in range(0, len(bins), 512):
                part = slice(at, at + 512)
                n = len(numbers[part])
                yield (numbers[part], [int(x[-1]) for x in lengths[part]], rows[part], [x.tolist() for x in lengths[part]],
                       resets[part], pa.ListArray.from_arrays(offsets, ids).slice(at, n),
                       pa.ListArray.from_arrays(offsets, starts).slice(at, n))

        held = 0
        for batch in sliced(batches, 256):
            for i, ids in enumerate(words.encode(as_bytes(batch.column(1)), end)):
                for at in range(0, len(ids), length * width):
                    pieces.append((batch.column(0).slice(i, 1), at // width, ids[at:at + length * width]))
                held += len(ids) // width
            if held >= group_ids:
                yield from packed()
                held = 0
        yield from packed()
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
         tokenizer: str = WORD_TOKENIZER, end: int | None = END_ID, pad: int = 0, group_ids: int = 4_000_000) -> DataFrame:
    """One row per sequence of ``length`` ids:

    ``sequence_id``; ``n_tokens`` before padding; ``ids`` and ``positions``, one row of a matrix each (unsigned
    little-endian, 16 bits for vocabularies that fit), positions starting anew at 0 with every segment;
    ``cumulative_lengths`` from 0 to ``n_tokens``; ``doc_ids`` and ``doc_starts`` per segment: the document it is from
    and the number of that document's ids before it.

    Null texts count as empty (only the end id); with ``end=None`` empty texts have no segment.  Null and repeated ids
    are packed row by row.  An empty table gives an empty result.  Positions have 16 bits, which bounds ``length``.
    """
    if not 0 < length <= 1 << 16:
        raise ValueError("length must be 1 to 65,536: positions have 16 bits")
    long = LongType()
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    return arrow_map(rows, _columns(length, tokenizer, end, pad, group_ids), StructType([
        StructField("sequence_id", long), StructField("n_tokens", long), StructField("ids", BinaryType()),
        StructField("cumulative_lengths", ArrayType(IntegerType())), StructField("positions", BinaryType()),
        StructField("doc_ids", ArrayType(docs.schema[id_col].dataType)), StructField("doc_starts", ArrayType(long))]))


def write_matrices(packed: DataFrame, path: str, rows: int = 1024) -> None:
    """Writes whole matrices: ``rows`` sequences a file row, ids and positions each as one binary block."""
    def run(batches):
        for batch in sliced(batches, rows):
            cells = [batch.column(i).to_pylist() for i in range(4)]
            yield ([cells[0][0]], [len(cells[0])], [b"".join(cells[1])], [b"".join(cells[2])], [cells[3]])

    source = packed.select("sequence_id", "ids", "positions", "cumulative_lengths")
    arrow_map(source, run, StructType([
        StructField("first_sequence_id", LongType()), StructField("rows", LongType()), StructField("ids", BinaryType()),
        StructField("positions", BinaryType()), StructField("cumulative_lengths", ArrayType(ArrayType(IntegerType())))])
    ).write.mode("errorifexists").parquet(path)


def segments(packed: DataFrame) -> DataFrame:
    """Back to ``(sequence_id, doc_id, doc_start, ids)``, one row per segment, for 16-bit ids."""
    return packed.select("sequence_id", "ids", F.posexplode(F.arrays_zip("doc_ids", "doc_starts")).alias("i", "s"),
                         "cumulative_lengths").select(
        "sequence_id", F.col("s.doc_ids").alias("doc_id"), F.col("s.doc_starts").alias("doc_start"),
        F.substring("ids", 2 * F.get("cumulative_lengths", F.col("i")) + 1,
                    2 * (F.get("cumulative_lengths", F.col("i") + 1) - F.get("cumulative_lengths", F.col("i")))).alias("ids"))
