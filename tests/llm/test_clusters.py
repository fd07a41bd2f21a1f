import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from alertloom.llm import walsh_clusters as walsh

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, seed=1):
    kept = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in (order + [r for r in kept if r[0] is None])[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            own = [v for (_, v), m in zip(kept, of) if m == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    total = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, total[n], sum(total.values()), names[n]) for i, d, n in found), key=str)


def test_transform_is_orthogonal_and_ordered_by_sign_changes():
    matrix = walsh.transform(np.eye(64, dtype=np.int64)).T
    assert (matrix @ matrix.T == 64 * np.eye(64)).all()
    assert ((np.diff(matrix, axis=1) != 0).sum(axis=1) == np.arange(64)).all()
    x = np.random.default_rng(0).integers(-walsh.LARGEST, walsh.LARGEST, (50, 64))
    assert (walsh.inverse(walsh.transform(x)) == x).all()
    assert (walsh.inverse(walsh.transform(x.astype(object))) == x).all()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 20), st.sampled_from([1, 3, 70, walsh.LARGEST]))
def test_nearest_is_exact_also_for_ties(seed, k, size):
    rng = np.random.default_rng(seed)
    vectors, centroids = rng.integers(-size, size + 1, (40, 64)), rng.integers(-size, size + 1, (k, 64))
    centroids[rng.integers(0, k)] = centroids[rng.integers(0, k)]  # an equal pair
    vectors[:5] = centroids[rng.integers(0, k, 5)]
    cluster, distance = walsh.nearest(walsh.transform(vectors), walsh.transform(centroids))
    want = ((vectors[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == want.argmin(axis=1)).all() and (distance == want.min(axis=1)).all()


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([(r.vec_id, r.embedding) for r in table.collect()])
    for frame in (table, table.repartition(7, "label").withColumns({c: F.lit(1) for c in ("_id", "cluster", "coefficients", "n")})):
        assert sorted((tuple(r) for r in walsh.cluster(frame).collect()), key=str) == want


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    sound = [rng.normal(0, 1, 64).tolist() for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(sound)] + [(3, sound[3]), (3, sound[3]), (100, sound[4]), (None, sound[5])]
    rows += [(200, None), (201, []), (202, sound[0][:63]), (203, sound[0] + [0.0]), (204, [None] + sound[0][1:]),
             (205, [float("nan")] + sound[0][1:]), (206, [float("-inf")] + sound[0][1:]), (207, [-0.0] * 64), (208, [1e-300] * 64)]
    table = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert sorted((tuple(r) for r in walsh.cluster(table).collect()), key=str) == brute(rows)
    few = table.where("vec_id < 5")
    assert sorted((tuple(r) for r in walsh.cluster(few).collect()), key=str) == brute([r for r in rows if r[0] is not None and r[0] < 5])
    same = spark.createDataFrame([(i, sound[0], None) for i in range(30)], SCHEMA)  # empty centroids stay, ties go to the first
    assert {(r.cluster, r.distance) for r in walsh.cluster(same).collect()} == {(0, 0)}
    for none in (table.limit(0), table.where("vec_id > 199 and vec_id < 207")):
        assert walsh.cluster(none).collect() == []
    with pytest.raises(Exception, match="scale the vectors down"):
        walsh.cluster(spark.createDataFrame([(1, [1e9] * 64, None)], SCHEMA)).collect()
