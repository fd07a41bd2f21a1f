"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n - 1 in the order of their id, whatever files or partitions they come from.  A keyed Feistel
network permutes the points 0 to a * b - 1, where a is the root of n rounded up and b is just large enough; a number
whose image is n or more walks on until it is below n, so that 0 to n - 1 is permuted.  The permuted number's remainder
by the number of shards is the row's shard, its quotient the slot there.  Shard sizes differ by one at most, and both
directions are arithmetic: :class:`Permutation` finds a row's shard and slot, and the row of a shard and slot, without
reading anything.

DataFrame operations only.  Numbers come from one range shuffle whose sort ends in a column that is different in every
row, so an id that a third of the rows share is spread like any other; a row's number is its place in its partition
plus the rows of the partitions before.
"""

import hashlib
import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertloom.llm.rows import wrapped
from alertloom.session import stage

PRIME = 2**31 - 1
ROUNDS = 6


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Per round an addend and two odd factors under 2**30, so that every product fits a signed 64-bit integer."""
    digests = [hashlib.sha256(f"{seed}:{r}".encode()).digest() for r in range(rounds)]
    return [tuple(int.from_bytes(d[at:at + 4], "big") >> 2 | 1 for at in (0, 4, 8)) for d in digests]


def _mixed(x, key, xor, shifted):
    """The round function, over numpy arrays or columns."""
    t = (x + key[0]) * key[1] % PRIME
    return xor(t, shifted(t)) * key[2] % PRIME


@dataclass(frozen=True)
class Permutation:
    """Of 0 to ``n`` - 1."""

    n: int
    seed: int = 0

    @cached_property
    def sides(self) -> tuple[int, int]:
        a = math.isqrt(max(self.n, 1) - 1) + 1
        return a, -(-max(self.n, 1) // a)

    @cached_property
    def keys(self) -> list[tuple[int, int, int]]:
        return round_keys(self.seed)

    def _points(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        """One pass of the network over all a * b points, or its inverse."""
        a, b = self.sides
        sign, mixed = -1 if back else 1, lambda v, key: _mixed(v, key, np.bitwise_xor, lambda t: t >> 15)
        left, right = x // b, x % b
        for r, key in list(enumerate(self.keys))[::sign]:
            if r % 2:
                right = (right + sign * mixed(left, key)) % b
            else:
                left = (left + sign * mixed(right, key)) % a
        return left * b + right

    def _walked(self, x, back: bool) -> np.ndarray:
        x = self._points(np.asarray(x, np.int64), back)
        while (x >= self.n).any():
            x = np.where(x >= self.n, self._points(x, back), x)
        return x

    def forward(self, x) -> np.ndarray:
        return self._walked(x, False)

    def inverse(self, x) -> np.ndarray:
        return self._walked(x, True)

    @cached_property
    def walks(self) -> int:
        """Further passes after which every number is back below ``n``: the longest chain among the points from n on.

        There are fewer of those than the root of n, rounded up.  Chains start at the image of a number; points that
        only lead to each other are never reached.
        """
        a, b = self.sides
        x, steps = np.arange(self.n, a * b, dtype=np.int64), 0
        x = x[self._points(x, back=True) < self.n]
        while len(x):
            x, steps = self._points(x), steps + 1
            x = x[x >= self.n]
        return steps

    def place(self, number: int, shards: int) -> tuple[int, int]:
        """Shard and slot of a row number."""
        at = int(self.forward([number])[0])
        return at % shards, at // shards

    def number(self, shard: int, slot: int, shards: int) -> int:
        """The row number at a shard's slot."""
        return int(self.inverse([slot * shards + shard])[0])

    def column(self, x: Column) -> Column:
        """:meth:`forward` as an expression."""
        a, b = self.sides
        keys = F.array(*(F.struct(F.lit(r % 2 == 1).alias("odd"), *(F.lit(k).cast("long").alias(f"k{i}") for i, k in enumerate(key)))
                         for r, key in enumerate(self.keys)))

        def turn(halves: Column, key: Column) -> Column:
            other = F.when(key["odd"], halves["l"]).otherwise(halves["r"])
            mixed = _mixed(other, (key["k0"], key["k1"], key["k2"]), lambda t, s: t.bitwiseXOR(s), lambda t: F.shiftright(t, 15))
            return F.struct(F.when(key["odd"], halves["l"]).otherwise((halves["l"] + mixed) % a).alias("l"),
                            F.when(key["odd"], (halves["r"] + mixed) % b).otherwise(halves["r"]).alias("r"))

        def passed(y: Column) -> Column:
            start = F.struct(F.call_function("div", y, F.lit(b)).alias("l"), (y % b).alias("r"))
            return F.aggregate(keys, start, turn, lambda halves: halves["l"] * b + halves["r"])

        x = passed(x.cast("long"))
        if not self.walks:
            return x
        steps = F.array(*(F.lit(0) for _ in range(self.walks)))
        return F.aggregate(steps, x, lambda y, _: F.when(y < self.n, y).otherwise(passed(y)))


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """The rows with ``_number``, 0 to n - 1 in ascending order of the named columns (nulls first), and n.

    Rows equal in all of them are numbered in any order.  The rows are written once, so that places stay as they are.
    """
    placed = stage(
        rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(
            *order, "_tie").withColumn("_place", F.monotonically_increasing_id()).drop("_tie"), "numbered")
    parts = placed.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("_n"))
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row a partition
    n = placed.count()
    numbers = placed.join(F.broadcast(before), F.shiftright("_place", 33) == F.col("_part")).withColumn(
        "_number", F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    return numbers.drop("_place", "_part", "_before"), n


def _spots(number: Column, permutation: Permutation, shards: int) -> tuple[Column, Column]:
    at = permutation.column(number)
    return (at % shards).cast("int").alias("shard"), F.call_function("div", at, F.lit(shards)).alias("slot")


def assign(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id>, size, text_crc32, shard, slot)`` for every row; texts are read once and not shuffled.

    ``size`` is the text's UTF-8 bytes plus 16, a null text having none.  Rows are numbered by id, size and CRC; rows
    equal in all three share these values, so which of them is meant does not matter.  Null ids come first, equal texts
    and equal ids are rows like any other.  An empty table gives an empty result.
    """
    text = F.coalesce(docs[text_col], F.lit("")).cast("binary")
    slim = stage(docs.select(docs[id_col].alias("_id"), (F.octet_length(text) + 16).cast("long").alias("size"),
                             F.crc32(text).alias("text_crc32")), "shard-rows")
    rows, n = numbered(slim, "_id", "size", "text_crc32")
    shard, slot = _spots(F.col("_number"), Permutation(n, seed), shards)
    return rows.select(F.col("_id").alias(id_col), "size", "text_crc32", shard, slot)


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """The whole rows with ``shard`` and ``slot`` (columns of these names are replaced).

    Rows of one id are numbered by a hash of all their columns, so the result depends on the rows alone.
    """
    rows, n = numbered(wrapped(docs, _id=id_col).withColumn("_hash", F.xxhash64("_row")), "_id", "_hash")
    shard, slot = _spots(F.col("_number"), Permutation(n, seed), shards)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return rows.select(*(F.col(f"_row.`{c}`") for c in own), shard, slot)


def write_shards(rows: DataFrame, path: str) -> None:
    """A folder per shard; its files hold runs of slots in ascending order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def assign_sql(shards: int, seed: int, crc_table: str, crc: str) -> str:
    """:func:`assign` over ``documents`` in SQL, walking one round of the network per step of a recursion."""
    keys = ", ".join(f"({r}, {a}, {b}, {c})" for r, (a, b, c) in enumerate(round_keys(seed)))
    mixed = lambda x: f"(xor(({x} + k0) * k1 % {PRIME}, (({x} + k0) * k1 % {PRIME}) >> 15) * k2 % {PRIME})"
    return f"""
with recursive {crc_table},
 rows as (select doc_id, octet_length(encode(coalesce(text, ''))) + 16 as size, {crc} as crc from documents, crc_table),
 size_of as (select count(*) as n, ceil(sqrt(count(*)))::bigint as a, (count(*) + ceil(sqrt(count(*)))::bigint - 1) // ceil(sqrt(count(*)))::bigint as b from rows),
 ordered as (select *, row_number() over (order by doc_id nulls first, size, crc) - 1 as number from rows),
 keys(step, k0, k1, k2) as (values {keys}),
 walk as (
   select number, n, a, b, number // b as l, number % b as r, 0 as step from ordered, size_of
   union all
   select number, n, a, b, case when step % 2 = 0 then (l + {mixed('r')}) % a else l end,
     case when step % 2 = 1 then (r + {mixed('l')}) % b else r end, step + 1
   from (select number, n, a, b, l, r, case when step = {ROUNDS} then 0 else step end as step from walk
         where step < {ROUNDS} or l * b + r >= n) join keys using (step)),
 done as (select number, (l * b + r)::bigint as spot from walk where step = {ROUNDS} and l * b + r < n)
select doc_id, size::bigint as size, crc as text_crc32, 'rows' as law, (spot % {shards})::int as shard,
  (spot // {shards})::bigint as slot, null::int as grown_shard
from ordered join done using (number)"""
