"""Nearest neighbours by a block matrix join: int8 tiles with error bounds, survivors in double precision, heaps of k.

Queries and rows are dealt into blocks by a hash of their ids; each pair of blocks is one task. Vectors are scaled to int8 by their
largest component. The quantised distance of a pair is off by at most the sum of both vectors' quantisation errors, which are known
exactly, so a pair whose lower bound exceeds the k-th smallest upper bound of its query can't be among the k nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions

TILE_ROWS, TILE_QUERIES = 8192, 256  # of a product that is held at once
EXACT = 1024  # dimensions over which int8 products add up exactly in float32: 1024 * 127**2 < 2**24


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, quantisation errors and quantised squared norms of the rows of ``x``."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(float).tiny)
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    return codes, scale, np.sqrt(((x - back) ** 2).sum(axis=1)) * (1 + 1e-9), (codes.astype(np.int32) ** 2).sum(axis=1) * scale**2


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of int8 rows, through float32 matrices."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at : at + EXACT].astype(np.float32) @ b[:, at : at + EXACT].astype(np.float32).T
    return out


def exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, components added in order."""
    total = np.zeros(len(rows))
    for i in range(rows.shape[1]):
        d = rows[:, i] - q[i]
        total += d * d
    return np.sqrt(total)


def thin(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Without rows that can't win a tie: of equal vectors, up to k rows of each of the k + 1 smallest ids (one may be a query's own)."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[order])
    same = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    by = np.argsort(same, kind="stable")
    at = np.arange(len(by))
    first = np.concatenate(([True], same[by][1:] != same[by][:-1]))
    new = first | np.concatenate(([True], ids[by][1:] != ids[by][:-1]))
    row = at - np.maximum.accumulate(np.where(new, at, 0))  # of its id
    turn = np.cumsum(new)
    turn -= np.maximum.accumulate(np.where(first, turn, 0))  # of its id among those of the vector
    keep = np.sort(by[(turn <= k) & (row < k)])
    return ids[keep], x[keep]


def search(qid: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, but for rows of its own id: query ids, ids, distances."""
    ids, x = thin(ids, x, k)
    qc, qs, qe, qn = quantise(q)
    np.seterr(over="ignore", invalid="ignore")
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    tiles = [(slice(at, at + TILE_ROWS), *quantise(x[at : at + TILE_ROWS])) for at in range(0, len(x), TILE_ROWS)]
    for at in range(0, len(q), TILE_QUERIES):
        part = slice(at, at + TILE_QUERIES)
        heaps = [(np.empty(0, np.int64), np.empty(0)) for _ in qid[part]]
        for rows, c, s, e, n in tiles:
            near = np.sqrt(np.maximum(qn[part][:, None] + n - 2 * qs[part][:, None] * s * products(qc[part], c), 0))
            slack = (qe[part][:, None] + e) + 1e-9 * near + 1e-12
            slack += 1e-7 * np.sqrt(qn[part][:, None] + n) * (near < 1e-3 * np.sqrt(qn[part][:, None] + n))  # where the subtraction cancels
            wide = ~np.isfinite(near)  # squares overflowed: no bound, the exact measure decides
            near[wide], slack[wide] = 0, np.inf
            own = qid[part][:, None] == ids[rows]
            high = np.where(own, np.inf, near + slack)
            most = np.partition(high, min(k, high.shape[1]) - 1, axis=1)[:, min(k, high.shape[1]) - 1] if high.shape[1] >= k else np.full(len(high), np.inf)
            for i, (have, score) in enumerate(heaps):
                limit = min(most[i], score[-1] if len(score) == k else np.inf)
                left = np.flatnonzero((near[i] - slack[i] <= limit) & ~own[i])
                if len(left):
                    all_ids = np.concatenate((have, ids[rows][left]))
                    all_scores = np.concatenate((score, exact(q[at + i], x[rows][left])))
                    best = np.lexsort((all_ids, all_scores))[:k]
                    heaps[i] = all_ids[best], all_scores[best]
        out += [(np.full(len(h), qid[at + i]), h, s) for i, (h, s) in enumerate(heaps)]
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def usable(v):
    """Not null, empty or zero, and all components finite."""
    finite = F.forall(v, lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", query_block: int = 4096, row_block: int = 65536) -> DataFrame:
    """Rows (query_id, rank from 1, ``key``, score): the ``k`` nearest rows of each query by Euclidean distance, ties to the smaller id.

    ``is_query`` is a condition on ``df``. Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    without an id. Rows with a query's id are its own; of several such queries, the smallest vector asks. Repeated rows are candidates each.
    Vectors meet those of their own dimension only. With fewer than k candidates all are returned; an empty table gives no rows.
    Memory of a task is bounded by one block of each side. Rows are sent once for each block of queries.
    """
    spark = df.sparkSession
    rows = df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("q"))
    rows = rows.withColumn("dim", F.size("v"))
    sizes = rows.agg(F.count("*"), F.sum(F.col("q").cast("int"))).first()
    n, asked = sizes[0], sizes[1] or 0
    row_blocks = max(1, -(-n // max(1024, min(row_block, -(-n // (2 * partitions(spark)))))))
    query_blocks = max(1, -(-asked // query_block))
    block = lambda seed, m: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    ask = rows.where("q").groupBy("id", "dim").agg(F.min("v").alias("v")).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("s"))
    ask = ask.select("id", "s.v", "s.dim", block(1, query_blocks).alias("a"), each(row_blocks).alias("b"))
    data = rows.select("id", "v", "dim", each(query_blocks).alias("a"), block(2, row_blocks).alias("b"))

    def vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return np.array(t.column("id").to_numpy()), np.array(flat).reshape(t.num_rows, -1)

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        a, b, s = search(*vectors(left), *vectors(right), k)
        return pa.table({"query_id": a, "id": b, "score": s})

    keys = ("dim", "a", "b")
    found = durable(ask.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(tile, "query_id long, id long, score double"))
    order = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
