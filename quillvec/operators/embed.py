"""Texts to vectors: the mean of the vectors of their tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from quillvec.operators.tokenizer import TokenizerModel, explode_tokens, once, parts, pieces_of


def mean_vector(df: DataFrame, by: list[str], vector: str = "vector", to: str = "vector", weight: str | None = None) -> DataFrame:
    """Component-wise means of ``vector`` by group, as doubles, optionally weighted. Components are summed in partial aggregations, so no group is
    gathered in one place. Null vectors count as absent; vectors of one group must be of one length. A group without any has no row."""
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    parts = df.where(F.col(vector).isNotNull()).select(*by, w.alias("_w"), F.posexplode(vector).alias("_dim", "_x"))
    sums = parts.groupBy(*by, "_dim").agg((F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_m"))
    ordered = F.array_sort(F.collect_list(F.struct("_dim", "_m")))  # as many as there are dimensions
    return sums.groupBy(*by).agg(F.transform(ordered, lambda s: s["_m"]).alias(to))


def token_counts(df: DataFrame, model: TokenizerModel, key: str = "doc_id", text: str = "text", strategy: str = "auto") -> DataFrame:
    """(key, token_id, n): a text's tokens with their number, unknown ones too."""
    tokens = explode_tokens(df.select(key, text), model, text, strategy)
    return tokens.groupBy(key, F.col("id").alias("token_id")).agg(F.count("*").alias("n"))


def embed(df: DataFrame, model: TokenizerModel, weights: DataFrame, key: str = "doc_id", text: str = "text", broadcast_bytes: int = 64 << 20, strategy: str = "auto") -> DataFrame:
    """``df`` with vector: the mean vector of each text's tokens, repeated ones counting each time; null where no token has a weight.

    ``weights`` has (token_id, vector), vectors of one length. If the measured size of those that the vocabulary names is at most ``broadcast_bytes``, they go to
    all tasks and each text's mean is made in the pass that reads it; of several weights of one token the first by id and vector counts. Else equal tokens of a text
    are counted, and both sides are shuffled by token; ``key`` must tell the rows apart then.
    """
    named = pa.table({"_token": pa.array(sorted({*model.vocab.values(), model.unk_id}), pa.int64())})
    known = weights.join(F.broadcast(df.sparkSession.createDataFrame(named)), F.col("token_id") == F.col("_token"), "left_semi")
    n, d = known.agg(F.count("*"), F.max(F.size("vector"))).first()
    if n * (d or 0) * 8 <= broadcast_bytes and strategy != "regex":
        return df.withColumn("vector", _means(df.sparkSession, model, known, d or 0)(F.col(text)))
    side = weights.select(F.col("token_id").alias("_token"), F.col("vector").alias("_v"))
    counts = token_counts(df, model, key, text, strategy)
    joined = counts.join(side, F.col("token_id") == F.col("_token"))
    return df.join(mean_vector(joined, [key], "_v", "vector", "n"), key, "left")


def _means(spark: SparkSession, model: TokenizerModel, weights: DataFrame, d: int):
    """A function of a text column: the mean of its tokens' vectors, in products of a small matrix for each text."""
    held = weights.where(F.size("vector") == d).select(F.col("token_id").cast("long").alias("t"), F.col("vector").cast("array<double>").alias("v")).toArrow()
    ids = held.column("t").to_numpy()
    matrix = np.array(held.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(len(ids), d)
    order = np.lexsort((*matrix.T[::-1], ids)) if len(np.unique(ids)) < len(ids) else np.argsort(ids)
    ids, first = np.unique(ids[order], return_index=True)
    sent = spark.sparkContext.broadcast((model.spec(), ids, matrix[order][first]))

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spec, ids, matrix = sent.value
        its = pieces_of(spec)
        tokens = its.ids.to_numpy().astype(np.int64)
        row = np.searchsorted(ids, tokens).clip(0, max(0, len(ids) - 1))
        row = np.where(ids[row] == tokens, row, -1) if len(ids) else np.full(len(tokens), -1)
        for texts in parts(batches):
            at, ends = its.places(texts)
            rows, out, none = row[at], np.zeros((len(texts), matrix.shape[1])), np.ones(len(texts), bool)
            for i, (a, z) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                mine = rows[a:z]
                mine = mine[mine >= 0]
                if len(mine):
                    use, n = np.unique(mine, return_counts=True)
                    out[i], none[i] = n @ matrix[use] / len(mine), False
            sizes = np.where(none, 0, out.shape[1])
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            yield pa.ListArray.from_arrays(offsets, pa.array(out[~none].ravel()), mask=pa.array(none))

    return once(run)
