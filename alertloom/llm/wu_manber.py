"""Benchmark decontamination by Wu-Manber search over words.

A test item gives one pattern per run of ``window`` consecutive words, or its whole text if it is shorter.  Patterns
of one length share a shift table on blocks of two words: the block that ends a position says how far the position can
move before any pattern may end there, so most of a text is never looked at.  Where the shift is 0, the block selects
a bucket of patterns, which are compared directly.

Items are searched in stated blocks of bounded size, each broadcast by itself, so the item table may grow: every
document meets every block, whole texts, in one pass without a shuffle.  A task builds one block's tables at a time and
searches a stretch of its documents for them before it builds the next; only the items' texts stay with the worker.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced

# Runs of ASCII letters, digits and all non-ASCII characters are words; A-Z count as a-z.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORDS).split() if text else []


class WuManber:
    """Patterns of one length, each with the items it comes from."""

    def __init__(self, patterns: dict[tuple, set[str]], length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, set[str]]] = {}
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                block = pattern[end - self.block:end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            self.buckets.setdefault(pattern[length - self.block:], {})[pattern] = items

    def search(self, words: list[bytes]):
        """``(first word, items)`` of every occurrence."""
        end, n, length, get, far = self.length, len(words), self.length, self.shift.get, self.far
        if self.block == 2:
            while end <= n:
                step = get((words[end - 2], words[end - 1]), far)
                if step:
                    end += step
                    continue
                items = self.buckets[words[end - 2], words[end - 1]].get(tuple(words[end - length:end]))
                if items:
                    yield end - length, items
                end += 1
        else:
            for at, word in enumerate(words):
                if (word,) in self.buckets:
                    yield at, self.buckets[word,][word,]


def matchers(items: list[tuple[str, bytes]], window: int) -> list[WuManber]:
    by_length: dict[int, dict[tuple, set[str]]] = {}
    for item, text in items:
        words = words_of(text)
        length = min(window, len(words))
        for at in range(len(words) - length + 1 if length else 0):
            by_length.setdefault(length, {}).setdefault(tuple(words[at:at + length]), set()).add(item)
    return [WuManber(p, n) for n, p in sorted(by_length.items())]


_built: list = [None, None]  # the only block of the last search, and its tables


def _tables(shared: list, window: int) -> Iterator[list[WuManber]]:
    """The tables of one block after the other; those of an only block are built once per worker."""
    if len(shared) == 1:
        key = (shared[0].value, window)
        if _built[0] is None or _built[0][0] is not key[0] or _built[0][1] != window:
            _built[:] = [key, matchers(*key)]
        yield _built[1]
        return
    for block in shared:
        yield matchers(block.value, window)


def _stretches(batches: Iterator[pa.RecordBatch], shared: list, rows: int = 512, stretch_bytes: int = 32 << 20):
    """The batches in lists: a slice alone for one block, as much as ``stretch_bytes`` for many."""
    held, size = [], 0
    for batch in sliced(batches, rows):
        held.append(batch)
        size += batch.nbytes
        if len(shared) == 1 or size >= stretch_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def hits(words: list[bytes], tables: list[WuManber]) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence, and the items that occur."""
    marks, items = np.zeros(len(words) + 1, np.int32), set()
    for table in tables:
        for at, found in table.search(words):
            marks[at] += 1
            marks[at + table.length] -= 1
            items |= found
    return np.cumsum(marks[:-1]) > 0, items


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, most_words: int) -> list:
    """Broadcasts of the items, each of items with about ``most_words`` words in all; the driver holds one at a time."""
    spark = benchmark.sparkSession
    items = benchmark.select(benchmark[id_col].cast("string").alias("item"), benchmark[text_col].alias("text")).where(
        "item is not null and text is not null")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * most_words)))
    out = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        out.append(spark.sparkContext.broadcast([(r["item"], r["text"].encode()) for r in rows]))
    return out


def _search_columns(shared: list, window: int):
    def run(batches):
        for held in _stretches(batches, shared):
            found = [[(np.packbits(np.zeros(0, bool)), set())] * b.num_rows for b in held]
            counts = [[0] * b.num_rows for b in held]
            for tables in _tables(shared, window):
                for batch, results, sizes in zip(held, found, counts):
                    for i, text in enumerate(as_bytes(batch.column(1))):
                        words = words_of(text)
                        marks, items = hits(words, tables)
                        if items:
                            before = np.unpackbits(results[i][0], count=len(words)).astype(bool) if results[i][1] else False
                            results[i] = np.packbits(marks | before), results[i][1] | items
                        sizes[i] = len(words)
            for batch, results, sizes in zip(held, found, counts):
                yield batch.column(0), [sorted(i) for _, i in results], sizes, [int(np.bitwise_count(m).sum()) for m, _ in results]
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", most_words: int = 400_000) -> DataFrame:
    """``(<id>, n_words, n_hit, items)`` for every row: its words, those inside an occurrence, and the items that occur.

    Null texts have no words; items without words or without an id match nothing.  An item listed twice counts once.
    Repeated rows repeat, rows with a null id are kept.  Without items nothing is hit.  An empty table gives an empty
    result.
    """
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    found = arrow_map(rows, _search_columns(item_blocks(benchmark, item_col, item_text, window, most_words), window), fields(
        rows, StructField("items", ArrayType(StringType())), StructField("n_words", LongType()),
        StructField("n_hit", LongType())))
    return found.select(F.col("_id").alias(id_col), "n_words", "n_hit", "items")


def uncontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", most_words: int = 400_000) -> DataFrame:
    """The rows, with all their columns, in which no item occurs.

    Null and empty texts hold no item and stay, as do all rows if there are no items; repeated rows are judged alike.
    An empty table gives an empty result.
    """
    shared, at = item_blocks(benchmark, item_col, item_text, window, most_words), docs.columns.index(text_col)

    def run(batches):
        for held in _stretches(batches, shared):
            clean = [np.ones(b.num_rows, bool) for b in held]
            for tables in _tables(shared, window):
                for batch, good in zip(held, clean):
                    for i, text in enumerate(as_bytes(batch.column(at))):
                        if good[i]:
                            words = words_of(text)
                            good[i] = not any(True for t in tables for _ in t.search(words))
            yield from (batch.filter(pa.array(good)) for batch, good in zip(held, clean))

    return docs.mapInArrow(run, docs.schema)
