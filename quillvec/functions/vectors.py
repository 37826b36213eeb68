"""Vector expressions on array columns, evaluated in the JVM in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: x.cast("double"))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product; cosine similarity of normalised vectors. A null vector gives 0, vectors of different length null."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).when(F.size(a) == F.size(b), total)


def l2_normalize(v: Column | str) -> Column:
    """The vector over its Euclidean norm; a zero vector, one whose norm is not a number, and null stay as they are.

    The norm is used in the finish step of one aggregation: named outside, the optimizer would compute it for each element.
    """
    v = as_double(v)
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x, lambda s: F.when((s > 0) & ~F.isnan(s), F.transform(v, lambda x: x / F.sqrt(s))).otherwise(v))


def units(m: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows and rows whose norm is not a number stay."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=m.copy(), where=norm > 0)


@F.arrow_udf(ArrayType(DoubleType()))
def _units(v: pa.Array) -> pa.Array:
    n = pa.compute.fill_null(pa.compute.list_value_length(v), 0).to_numpy(zero_copy_only=False)
    flat = np.array(v.flatten().to_numpy(zero_copy_only=False), float)
    ends = np.cumsum(n)
    total = np.zeros(len(n))
    if len(flat):
        full = n > 0
        total[full] = np.add.reduceat(flat * flat, (ends - n)[full])
    norm = np.sqrt(total)
    out = flat / np.repeat(np.where(norm > 0, norm, 1.0), n)
    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out), mask=pa.compute.is_null(v)) if v.null_count else pa.ListArray.from_arrays(offsets, pa.array(out))


def l2_normalize_batches(v: Column | str) -> Column:
    """As :func:`l2_normalize`, in NumPy on Arrow batches: for vectors of many dimensions, where the interpreted expression is slow."""
    return _units(_col(v))


def block_mean(v: Column | str, width: int = 4) -> Column:
    """Means of each ``width`` neighbouring components; a shorter rest is left out."""
    v = _col(v)
    n = F.floor(F.size(v) / width).cast("int")
    mean = lambda i: F.aggregate(F.slice(v, i * width + 1, F.lit(width)), F.lit(0.0), lambda s, x: s + x.cast("double")) / width
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), mean)).when(v.isNotNull(), F.array().cast("array<double>"))


@F.pandas_udf(StringType())
def _spelled(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else "[" + ", ".join(f"{float(x):.6g}" for x in v) + "]")


def vector_to_string(v: Column | str) -> Column:
    """``[a, b, c]`` with 6 significant digits, trailing zeros dropped. An Arrow batch function: the JVM's %g keeps the zeros."""
    return _spelled(_col(v))


@F.pandas_udf(StringType())
def _spelled_rows(matrices: pd.Series) -> pd.Series:
    one = lambda v: "[" + ", ".join(f"{float(x):.6g}" for x in v) + "]"
    return matrices.map(lambda m: None if m is None else "[" + ", ".join(one(v) for v in m) + "]")


def matrix_to_string(m: Column | str) -> Column:
    """A list of vectors, each as :func:`vector_to_string` writes it, in brackets."""
    return _spelled_rows(_col(m))
