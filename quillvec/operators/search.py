"""Cosine top-k: one query, many queries, one cluster, and texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillvec.functions.text import first_line
from quillvec.functions.vectors import as_double, dot, l2_normalize
from quillvec.operators.cluster import literal, nearest


def _unit(v: list[float]) -> list[float]:
    total = 0.0
    for x in v:
        total += float(x) * float(x)
    return [float(x) / total**0.5 for x in v] if total > 0 else [float(x) for x in v]


def _check(k: int) -> None:
    if k < 0:
        raise ValueError("k must not be negative")


def knn_exact(entries: DataFrame, query: list[float], k: int, key: str = "id", vector: str = "vector", normalized: bool = False, digits: int | None = None) -> DataFrame:
    """``entries`` with similarity, the ``k`` best first, ties to the smaller id.

    The query is a literal, so each task scores its rows and keeps k of them (TakeOrderedAndProject). Vectors of another dimension are left out; a similarity
    that is not a number comes last. k above the number of rows gives all, k = 0 none, k < 0 is an error. ``normalized`` entries are
    taken as they are. ``digits`` rounds before ranking.
    """
    _check(k)
    v = F.col(vector) if normalized else l2_normalize(vector)
    sim = F.nanvl(dot(v, literal(_unit(query))), F.lit(None).cast("double"))
    scored = entries.where(F.size(vector) == len(query)).withColumn("similarity", sim if digits is None else F.round(sim, digits))
    return scored.orderBy(F.desc_nulls_last("similarity"), F.asc(key)).limit(k)


def knn_clustered(entries: DataFrame, centroids: list[list[float]], query: list[float], k: int, key: str = "id", vector: str = "vector", cluster: str = "cluster_id", **options) -> DataFrame:
    """As :func:`knn_exact`, in the query's nearest cluster only: a literal filter on the column by which entries are stored, so other clusters aren't read."""
    if not centroids or len(query) != len(centroids[0]):
        return knn_exact(entries.limit(0), query, k, key, vector, **options)
    unit = _unit(query)
    sims = [sum(a * b for a, b in zip(unit, c, strict=True)) for c in centroids]
    home = max(range(len(sims)), key=lambda i: (sims[i], -i))
    return knn_exact(entries.where(F.col(cluster) == home), query, k, key, vector, **options)


def knn_join(
    queries: DataFrame, entries: DataFrame, k: int, query_key: str = "query_id", key: str = "id", vector: str = "vector", cluster: str | None = None,
    query_block: int = 4096, digits: int | None = None, skip_self: bool = False,
) -> DataFrame:
    """Rows (query_key, rank from 1, key, similarity): the ``k`` best entries of each query, ties to the smaller id.

    Up to ``query_block`` queries are sent to all tasks, and entries stay where they are. More are cut into blocks of at most that size; each block
    meets each block of entries in one task. Either way a task multiplies two matrices and keeps k rows a query, and the last rank is over these. With ``cluster``, a column of both, only
    entries of the query's cluster are met. Dimensions must be equal; others take no part. ``skip_self`` leaves out equal ids.
    """
    _check(k)
    n_queries = queries.count()
    spark = entries.sparkSession
    q_blocks = max(1, -(-n_queries // query_block))
    e_blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    group = [F.col(cluster).cast("long").alias("g")] if cluster else [F.lit(0).cast("long").alias("g")]
    deal = lambda c, n, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    plain = ("array<float>", "array<double>")  # widened by the tasks; other types are cast here
    vector_of = lambda df: F.col(vector) if df.schema[vector].dataType.simpleString() in plain else as_double(vector)
    left = queries.select(F.col(query_key).cast("long").alias("i"), vector_of(queries).alias("v"), *group).where("v is not null")
    right = entries.select(F.col(key).cast("long").alias("i"), vector_of(entries).alias("v"), *group).where("v is not null")

    def matrix(t: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        column = t.column("v").combine_chunks() if isinstance(t, pa.Table) else t.column("v")
        m = np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, -1)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        return np.array(t.column("i").to_numpy()), np.divide(m, norm, out=m.copy(), where=norm > 0)

    def best_of(qi: np.ndarray, q: np.ndarray, ei: np.ndarray, e: np.ndarray) -> list[tuple]:
        out = []
        order = np.argsort(ei, kind="stable")
        ei, e = ei[order], e[order]
        for at in range(0, len(q), 256):
            sims = np.nan_to_num(q[at : at + 256] @ e.T, nan=-np.inf)
            if digits is not None:
                sims = np.round(sims, digits)
            if skip_self:
                sims[qi[at : at + 256, None] == ei] = -np.inf
            for row, i in zip(sims, qi[at : at + 256], strict=True):
                edge = np.partition(row, -k)[-k] if k < len(row) else -np.inf
                near = np.flatnonzero(row >= edge)
                best = near[np.argsort(-row[near], kind="stable")][:k]
                best = best[row[best] > -np.inf]
                out.append((np.full(len(best), i), ei[best], row[best]))
        return out

    def rows_of(out: list[tuple]) -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

    names, found_as = ("i", "e", "similarity"), "i long, e long, similarity double"
    ranking = Window.partitionBy("i").orderBy(F.desc("similarity"), "e")

    def ranked(found: DataFrame) -> DataFrame:
        out = found.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= k)
        return out.select(F.col("i").alias(query_key), "rank", F.col("e").alias(key), "similarity")

    if q_blocks == 1:
        held: dict[tuple, tuple] = {}
        asked = left.withColumn("d", F.size("v")).toArrow()  # at most ``query_block`` rows
        for pair in sorted(set(zip(asked.column("g").to_pylist(), asked.column("d").to_pylist(), strict=True)), key=str):
            same = [(g, d) == pair for g, d in zip(asked.column("g").to_pylist(), asked.column("d").to_pylist(), strict=True)]
            held[pair] = matrix(asked.filter(pa.array(same)))
        sent = spark.sparkContext.broadcast(held)

        def scan(batches):
            for b in batches:
                out: list[tuple] = []
                sizes = pa.compute.list_value_length(b.column("v")).to_numpy(zero_copy_only=False)
                groups = b.column("g").to_numpy(zero_copy_only=False)
                for (g, d), (qi, q) in sent.value.items():
                    mine = (sizes == d) & ((groups == g) if g is not None else np.zeros(len(sizes), bool))
                    if mine.any() and k:
                        out += best_of(qi, q, *matrix(b if mine.all() else b.filter(pa.array(mine))))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows_of(out)], names=list(names))

        return ranked(right.mapInArrow(scan, found_as))

    left = left.select("i", "v", "g", F.size("v").alias("d"), deal("i", q_blocks, 1).alias("a"), every(e_blocks).alias("b"))
    right = right.select("i", "v", "g", F.size("v").alias("d"), every(q_blocks).alias("a"), deal("i", e_blocks, 2).alias("b"))

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        out = best_of(*matrix(a), *matrix(b)) if a.num_rows and b.num_rows and k else []
        return pa.table(dict(zip(names, rows_of(out), strict=True)))

    keys = ("g", "d", "a", "b")
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, found_as))


def with_cluster(df: DataFrame, centroids: list[list[float]], vector: str = "vector", cluster: str = "cluster_id") -> DataFrame:
    return df.withColumn(cluster, nearest(l2_normalize(vector), centroids).cast("int"))


def search_concat(results: DataFrame, by: list[str] | None = None, text: str = "text", to: str = "result") -> DataFrame:
    """The first lines of a query's results in order of rank, each ended by a line feed. Results are k rows a query."""
    rows = F.array_sort(F.collect_list(F.struct("rank", first_line(text).alias("t"))))
    joined = F.concat(F.array_join(F.transform(rows, lambda r: r["t"]), "\n"), F.lit("\n"))
    made = F.when(F.size(F.collect_list(text)) > 0, joined).otherwise(F.lit("")).alias(to)
    return results.where(F.col(text).isNotNull()).groupBy(*(by or [])).agg(made)


def search_text(entries: DataFrame, query: list[float], k: int, text: str = "text", **options) -> str:
    """First lines of the texts of the ``k`` nearest entries, each with a line feed; empty for a query without a vector."""
    if not query:
        return ""
    rows = knn_exact(entries, query, k, **options).select(first_line(text).alias("t")).collect()
    return "".join(r["t"] + "\n" for r in rows if r["t"] is not None)
