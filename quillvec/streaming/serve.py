"""Streams of queries against stored entries, and streams of vectors into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillvec.operators import search
from quillvec.operators.store import VectorStore


def serve(queries: DataFrame, entries: DataFrame, k: int, sink, checkpoint: str, query_key: str = "query_id", vector: str = "vector") -> StreamingQuery:
    """Answers each micro-batch of a query stream: ``sink(results, batch_id)`` gets (query_key, rank, id, similarity). Ranking needs a whole batch, so the
    join is done per batch against the static entries; there is no state to keep."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        sink(search.knn_join(batch, entries, k, query_key=query_key, vector=vector), batch_id)

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()


def scored(queries: DataFrame, entries: DataFrame, query_key: str = "query_id", vector: str = "vector", at_least: float = 0.0) -> DataFrame:
    """A stream–static join in append mode: (query_key, id, similarity) of pairs at or above a similarity; for small sets of entries."""
    from quillvec.functions.vectors import dot, l2_normalize

    q = queries.select(query_key, l2_normalize(vector).alias("_q"))
    e = entries.select("id", l2_normalize("vector").alias("_e"))
    return q.crossJoin(e).select(query_key, "id", dot("_q", "_e").alias("similarity")).where(F.col("similarity") >= at_least)


def ingest(vectors: DataFrame, store: VectorStore, checkpoint: str, text: str | None = None, order: str | None = None) -> StreamingQuery:
    """Adds each micro-batch of a stream to a store. The store keeps the number of the last one under the name of the checkpoint, so a batch that
    was added before a failure or a restart is not added again."""

    def add(batch: DataFrame, batch_id: int) -> None:
        store.add(batch, "vector", text, order, once=(checkpoint, batch_id))

    return vectors.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
