"""Centroid clustering by Walsh-Hadamard progressive search, exact in integers.

Vectors of 64 components become integers, floor(64 x), and are transformed once by the Walsh-Hadamard transform, an
integer transform that multiplies squared distances by 64.  The coefficients stand in order of sequency, coarse first.
To find a vector's nearest centroid, squared coefficient differences are accumulated level by level.  The leading
centroid's whole distance is a bound; a centroid whose partial sum is strictly above it can neither win nor tie and is
dropped, the others are finished over all 64 coefficients.

Every pass over the vectors keeps sums of one batch; a task gives one row per centroid to the shuffle, and only sums by
centroid reach the driver.  Vectors are compared in 64-bit integers, exact for integer components up to 2**24.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from alertloom.llm.rows import arrow_map, fields, sliced
from alertloom.session import stage

DIMS = 64
LEVELS = (1, 2, 4, 8, 16, 32, DIMS)
LEADERS = (4, 16)  # levels at which the leading centroid is finished
SCALE = 64
LARGEST = 1 << 24
_FAR = np.iinfo(np.int64).max


def _sequency() -> np.ndarray:
    """Rows of the Hadamard matrix by their number of sign changes."""
    index = np.arange(DIMS)
    bits = (np.bitwise_count(index[:, None] & index[None, :]) & 1).astype(np.int8)
    return np.argsort((np.diff(bits, axis=1) != 0).sum(axis=1), kind="stable")


ORDER = _sequency()
BACK = np.argsort(ORDER)


def _butterflies(x: np.ndarray) -> np.ndarray:
    n, step = x.shape[0], 1
    while step < DIMS:
        pairs = x.reshape(n, DIMS // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, DIMS)
        step *= 2
    return x


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients by sequency of integer vectors (64-bit or Python integers)."""
    return _butterflies(vectors)[:, ORDER]


def inverse(coefficients: np.ndarray) -> np.ndarray:
    return _butterflies(coefficients[:, BACK]) // DIMS


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 x) of doubles; beyond 2**24 the search would not be exact, which is an error."""
    scaled = np.floor(values * SCALE)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component is beyond {LARGEST // SCALE}; scale the vectors down")
    return scaled.astype(np.int64)


def nearest(coefficients: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smallest of equally near ones) and the squared distance, per vector."""
    n, k = len(coefficients), len(centroids)
    total, alive, bound = np.zeros((n, k), np.int64), np.ones((n, k), bool), np.full(n, _FAR)
    at, start = np.arange(n), 0
    for end in LEVELS:
        row, c = np.nonzero(alive)
        apart = coefficients[row, start:end] - centroids[c, start:end]
        total[row, c] += np.einsum("ij,ij->i", apart, apart)
        if end in LEADERS and k > 1:
            leader = np.where(alive, total, _FAR).argmin(axis=1)
            rest = coefficients[:, end:] - centroids[leader, end:]
            bound = np.minimum(bound, total[at, leader] + np.einsum("ij,ij->i", rest, rest))
        alive &= total <= bound[:, None]
        start = end
    total[~alive] = _FAR
    cluster = total.argmin(axis=1)
    return cluster, total[at, cluster] // DIMS


def _coefficient_columns(batches):
    for batch in sliced(batches, 4096):
        values = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(-1, DIMS)
        yield batch.column(0), pa.array([row.tobytes() for row in transform(integers(values)).astype("<i4")], pa.binary())


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, DIMS).astype(np.int64)


def _sum_columns(centroids: np.ndarray):
    def run(batches):
        count, sums = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), DIMS), np.int64)
        for batch in sliced(batches, 2048):
            found = _matrix(batch.column(0))
            cluster, _ = nearest(found, centroids)
            count += np.bincount(cluster, minlength=len(centroids))
            np.add.at(sums, cluster, found)
        used = np.flatnonzero(count)
        yield used.tolist(), count[used].tolist(), sums[used].tolist()
    return run


def _nearest_columns(centroids: np.ndarray):
    def run(batches):
        for batch in sliced(batches, 2048):
            cluster, distance = nearest(_matrix(batch.column(1)), centroids)
            yield batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance)
    return run


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    schema = StructType([StructField("cluster", IntegerType()), StructField("n", LongType()),
                         StructField("sums", ArrayType(LongType()))])
    part = arrow_map(vectors.select("coefficients"), _sum_columns(transform(np.array(centroids, np.int64))), schema)
    sums = part.groupBy("cluster").agg(
        F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i].cast("decimal(20,0)")) for i in range(DIMS))).alias("sums"))
    moved = list(centroids)
    for row in sums.collect():  # a row a centroid
        whole = inverse(np.array([[int(x) for x in row["sums"]]], object))[0]
        moved[row["cluster"]] = [int(x) // row["n"] for x in whole]
    return moved


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3,
            seed: int = 1) -> DataFrame:
    """``(<id>, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` for every vector that is kept.

    Kept are vectors of 64 components, none of them null, NaN or infinite.  Centroids start as the ``k`` kept vectors
    with the smallest SHA-256 of ``<seed>:<id>`` (all, if there are fewer; rows of one id by their coefficients, null
    ids last), move ``rounds`` times, and take the vectors once more.  Repeated rows count and are returned each.
    Ties go to the smaller number.  An empty table, or one without kept vectors, gives an empty result.
    """
    vector = table[vector_col].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce((F.size(vector) == DIMS) & finite, F.lit(False))
    rows = table.where(sound).select(table[id_col].alias("_id"), vector.alias("_vector"))
    vectors = stage(arrow_map(rows, _coefficient_columns, fields(rows, StructField("coefficients", BinaryType()))), "walsh-vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")), 256)
    first = vectors.orderBy(name.asc_nulls_last(), "coefficients").limit(k).collect()
    centroids = inverse(_matrix(pa.array([r["coefficients"] for r in first], pa.binary()))).tolist() if first else []
    for _ in range(rounds if centroids else 0):
        centroids = _moved(vectors, centroids)
    schema = fields(vectors, StructField("cluster", IntegerType()), StructField("distance", LongType()))
    found = stage(arrow_map(vectors, _nearest_columns(transform(np.array(centroids, np.int64).reshape(-1, DIMS))), schema), "walsh-nearest")
    sums = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    totals = table.sparkSession.createDataFrame(
        [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in sums.items()],
        "_cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(totals), F.col("cluster") == F.col("_cluster")).select(  # k rows at most
        F.col("_id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 16, rounds: int = 3, seed: int = 1) -> str:
    """:func:`cluster` over ``embeddings`` in SQL, comparing all components with all centroids."""
    apart = f"list_sum([(v[i] - m[i]) * (v[i] - m[i]) for i in range(1, {DIMS + 1})])::bigint"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as (select n, any_value(vec_id) as vec_id, any_value(v) as v, min({{'d': d, 'c': c}}) as best
   from (select n, vec_id, v, c, {apart} as d from kept, c{r}) group by n)""")
        if r < rounds:
            steps.append(f"""u{r} as (select c, list(x order by i) as m from (
     select c, i, ((s - ((s % size) + size) % size) // size)::bigint as x from (
       select best.c as c, i, sum(v[i])::bigint as s, count(*) as size from a{r}, range(1, {DIMS + 1}) t(i) group by 1, 2)) group by c),
 c{r + 1} as (select c, coalesce(u{r}.m, c{r}.m) as m from c{r} left join u{r} using (c))""")
    return f"""
with kept as (select row_number() over () as n, vec_id, [floor({SCALE} * x::double)::bigint for x in embedding] as v from embeddings
   where len(embedding) = {DIMS} and list_bool_and([x is not null and isfinite(x) for x in embedding])),
 first as (select vec_id, v, sha256('{seed}:' || vec_id) as name from kept order by name, v limit {k}),
 c0 as (select row_number() over (order by name, v) - 1 as c, v as m from first),
 {", ".join(steps)}
select vec_id, best.c::int as cluster, best.d as distance, (sum(best.d) over (partition by best.c))::bigint as cluster_inertia,
  (sum(best.d) over ())::bigint as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from a{rounds} join c{rounds} on best.c = c{rounds}.c"""
