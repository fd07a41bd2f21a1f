import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from alertloom.llm import feistel_shards as shards
from tests.llm.helpers import frame, odd_rows


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 39, 40, 41, 97, 1000, 10_007])
def test_numbers_are_permuted_and_found_again(n):
    p = shards.Permutation(n, seed=3)
    x = np.arange(n)
    y = p.forward(x)
    assert sorted(y.tolist()) == x.tolist() and (p.inverse(y) == x).all()
    assert n < 40 or (y != x).mean() > 0.9
    for number in range(0, n, max(1, n // 7)):
        shard, slot = p.place(number, 40)
        assert p.number(shard, slot, 40) == number


def test_permuted_numbers_look_shuffled():
    n = 40_000
    y = shards.Permutation(n, seed=8).forward(np.arange(n))
    assert abs(np.corrcoef(np.arange(n), y)[0, 1]) < 0.03 and abs(np.corrcoef(y[1:], y[:-1])[0, 1]) < 0.03
    neighbours = Counter(((y[1:] % 40) * 40 + y[:-1] % 40).tolist())
    chi = sum((c - n / 1600) ** 2 / (n / 1600) for c in neighbours.values()) + (1600 - len(neighbours)) * n / 1600
    assert chi < 1600 + 5 * (2 * 1600) ** 0.5
    assert (shards.Permutation(n, seed=9).forward(np.arange(n)) == y).mean() < 0.01


@pytest.mark.parametrize("n", [1, 7, 1000, 3_000_000_019, 10**15 + 37])
def test_expression_equals_arithmetic(spark, n):
    p = shards.Permutation(n, seed=5)
    some = sorted({random.Random(n).randrange(n) for _ in range(300)} | {0, n - 1})
    if n < 10**12:
        top = p.sides[0] * p.sides[1]
        outside = np.arange(n, top)
        some += [int(x) for x in p._points(outside, back=True) if x < n][:200]  # numbers that walk
    else:
        p.__dict__["walks"] = 3  # the chain count reads a root of n points
    got = spark.createDataFrame([(x,) for x in some], "x long").select(p.column(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == p.forward(some).tolist()


def check(rows, got, n_shards=40):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    per = {}
    for r in got:
        per.setdefault(r.shard, []).append(r.slot)
    sizes = [len(per.get(s, ())) for s in range(n_shards)]
    assert set(per) <= set(range(n_shards)) and (not rows or max(sizes) - min(sizes) <= 1)
    assert all(sorted(v) == list(range(len(v))) for v in per.values())


def test_odd_rows_fall_alike_however_they_are_dealt(spark):
    rows = odd_rows() + [(77, f"same id {i % 9}", "en", "s", 1) for i in range(300)] + [(None, f"none {i}", "en", "s", 1) for i in range(100)]
    docs = frame(spark, rows, clashing=True).withColumns({c: F.lit(1) for c in ("shard", "slot", "size", "_number", "_place", "_tie")})
    got = shards.assign(docs, 40, seed=2).collect()
    check(rows, got)
    other = shards.assign(docs.repartition(7, "text"), 40, seed=2).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, other))
    assert Counter(map(tuple, shards.assign(docs, 40, seed=3).collect())) != Counter(map(tuple, got))
    p, ids = shards.Permutation(len(rows), 2), {r.doc_id: (r.shard, r.slot) for r in got if r.doc_id in (0, 1, 5, 6)}
    numbers = {i: sum(r[0] is None or r[0] < i for r in rows) for i in ids}
    assert {i: p.place(n, 40) for i, n in numbers.items()} == ids
    check([], shards.assign(frame(spark, []), 40).collect())


def test_whole_rows_in_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = shards.shuffled(docs, 7, seed=1)
    assert Counter(map(tuple, rows.drop("shard", "slot").collect())) == Counter(map(tuple, docs.collect()))
    shards.write_shards(rows, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted((r.doc_id, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, r.shard, r.slot) for r in rows.collect())
    sizes = [r["count"] for r in back.groupBy("shard").count().collect()]
    assert len(sizes) == 7 and max(sizes) - min(sizes) <= 1


def test_no_python_on_the_executors(spark):
    plan = shards.assign(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
