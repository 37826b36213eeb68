"""Spherical k-means: centroids are a literal, so an assignment is a projection and only the means are shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillvec.functions.vectors import dot, l2_normalize, l2_normalize_batches, units
from quillvec.operators.embed import mean_vector

CLUSTERS = 6
ITERATIONS = 6


def literal(v: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def nearest(vector: Column | str, centroids: list[list[float]]) -> Column:
    """Index of the centroid with the largest dot product; ties, and vectors that compare with none, to the lowest."""
    v = F.col(vector) if isinstance(vector, str) else vector
    sims = F.transform(F.array(*[literal(c) for c in centroids]), lambda c, i: F.struct(F.nanvl(dot(v, c), F.lit(None).cast("double")).alias("s"), (-i).alias("i")))
    return F.coalesce(-F.array_max(F.filter(sims, lambda x: x["s"].isNotNull()))["i"], F.lit(0))


def homes(centroids: list[list[float]]):
    """A function of a vector column: as :func:`nearest`, in matrix products on Arrow batches, for vectors of many dimensions. Vectors of another dimension go to the lowest."""
    held = np.array(centroids, float)

    @F.arrow_udf(IntegerType())
    def run(v: pa.Array) -> pa.Array:
        n = pa.compute.fill_null(pa.compute.list_value_length(v), 0).to_numpy(zero_copy_only=False)
        ok = n == held.shape[1]
        out = np.zeros(len(n), np.int32)
        if ok.any():
            m = np.array((v if ok.all() else v.filter(pa.array(ok))).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, held.shape[1])
            out[ok] = np.nan_to_num(m @ held.T, nan=-np.inf).argmax(axis=1)
        return pa.array(out)

    return run


def assign(df: DataFrame, centroids: list[list[float]], vector: str = "vector", to: str = "cluster_id") -> DataFrame:
    return df.withColumn(to, nearest(vector, centroids).cast("int"))


def update(df: DataFrame, centroids: list[list[float]], vector: str = "vector", cluster: str = "cluster_id") -> list[list[float]]:
    """New centroids: normalised means; an empty cluster keeps its own. One small row per cluster comes to the driver."""
    means = mean_vector(df, [cluster], vector, "_m").select(cluster, l2_normalize("_m").alias("_m"))
    new = {r[0]: list(r[1]) for r in means.collect()}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def step(df: DataFrame, centroids: list[list[float]], vector: str = "vector") -> list[list[float]]:
    """One assignment and update of normalised vectors, as :func:`assign` and :func:`update` do, in matrix products on Arrow batches: each task sends
    one sum for each cluster."""
    held = np.array(centroids, float)

    def sums(batches):
        total, n = np.zeros_like(held), np.zeros(len(held), np.int64)
        for b in batches:
            m = np.array(b.column(0).flatten().to_numpy(zero_copy_only=False), float).reshape(b.num_rows, -1)
            home = np.nan_to_num(m @ held.T, nan=-np.inf).argmax(axis=1)
            for c in np.unique(home):
                total[c] += m[home == c].sum(axis=0)
                n[c] += int((home == c).sum())
        use = np.flatnonzero(n)
        vectors = pa.array(total[use].tolist(), pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), vectors, pa.array(n[use])], names=["c", "total", "n"])

    parts = df.select(vector).mapInArrow(sums, "c int, total array<double>, n long")
    flat = parts.select("c", "n", F.posexplode("total").alias("dim", "x")).groupBy("c", "dim").agg((F.sum("x") / F.sum("n")).alias("m"))
    means = flat.groupBy("c").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("m")).collect()
    new = {r["c"]: units(np.array([r["m"]]))[0].tolist() for r in means}
    return [new.get(i, c) for i, c in enumerate(centroids)]


def seeds(df: DataFrame, k: int = CLUSTERS, key: str = "id", vector: str = "vector", seed: int | None = None) -> list[list[float]]:
    """The first ``k`` different non-zero vectors by id, or by a hash of the id with ``seed``; normalised."""
    order = F.col(key) if seed is None else F.xxhash64(key, F.lit(seed))
    rows = df.select(vector, order.alias("_o")).where(F.exists(vector, lambda x: x != 0)).orderBy("_o", vector)
    n, found = max(16, 4 * k), {}
    while True:  # the smallest ids, more and more of them until there are enough different vectors
        some = rows.limit(n).select(l2_normalize(vector)).collect()
        found = dict.fromkeys(tuple(r[0]) for r in some)
        if len(found) >= k or len(some) < n:
            return [list(v) for v in found][:k]
        n *= 8


def fit(df: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, key: str = "id", vector: str = "vector", seed: int | None = None, compat: str = "intended", normalized: bool = False) -> list[list[float]]:
    """Centroids after (assign, update) as often as ``iterations`` says. Each round is one pass and one small shuffle; its only state is the centroids.

    ``compat="legacy"`` gives zero centroids, as a clustering without a last update leaves them: every search then sees cluster 0. ``normalized`` vectors are taken as they are.
    """
    centroids = seeds(df, k, key, vector, seed)
    if compat == "legacy":
        return [[0.0] * len(c) for c in centroids]
    if not centroids:
        return centroids
    rows = df.where(F.size(vector) == len(centroids[0])).select((F.col(vector) if normalized else l2_normalize_batches(vector)).alias("_v"))
    if iterations > 1:
        rows = rows.persist()  # read and normalised once; what is lost is made anew
    for _ in range(iterations):
        centroids = step(rows, centroids, "_v")
    if iterations > 1:
        rows.unpersist()
    return centroids
