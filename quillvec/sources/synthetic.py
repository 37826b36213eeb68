"""Seeded random vectors, for tests and benches of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """(id, vector) with components uniform in [-1, 1). A component is a hash of seed, id and place, so rows are the same however they are dealt."""
    ids = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    part = lambda i: (F.pmod(F.xxhash64(F.lit(seed), "id", i), F.lit(1 << 24)) / F.lit(float(1 << 23)) - 1).cast("float")
    places = F.sequence(F.lit(0), F.lit(dim - 1)) if dim else F.array().cast("array<int>")
    return ids.select("id", F.transform(places, part).alias("vector"))
