import numpy as np
import pytest
from pyspark.sql import functions as F

from quillvec.llm import nearest


def brute(rows, queries, k):
    out = {}
    for qi, q in queries:
        near = []
        for i, v in rows:
            if i != qi and len(v) == len(q):
                total = 0.0
                for x, y in zip(v, q, strict=True):
                    total += (x - y) * (x - y)
                near.append((total**0.5, i))
        out[qi] = sorted(near)[:k]
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(700)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, rows[0][1]), (2100, rows[3][1])]  # ties and equal vectors
    rows += [(3000 + i, (rng.normal(size=16) * 1e-3 + 5).tolist()) for i in range(100)]  # far from the origin, close together
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, id int")
    want = brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
    for block in (4096, 3):
        got = {}
        for r in nearest.nearest(df, F.col("vec_id") % 100 == 0, query_block=block).collect():
            got.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
        assert {q: [(s, i) for _, s, i in sorted(v)] for q, v in got.items()} == want


def test_quantisation_bound():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 33)) * rng.uniform(0.01, 100, size=(200, 1))
    codes, scale, error, norm = nearest.quantise(x)
    near = np.sqrt(np.maximum(norm[:, None] + norm - 2 * scale[:, None] * scale * nearest.products(codes, codes), 0))
    true = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    assert (np.abs(near - true) <= error[:, None] + error + 1e-6).all()
    wide = rng.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (nearest.products(wide, wide) == wide.astype(int) @ wide.astype(int).T).all()


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, None), (200, []), (300, [0.0, 0.0]), (400, [1.0, nan]), (500, [inf, 0.0]), (600, [None, 1.0]), (700, [3.0, 4.0, 5.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (None, [1.0, 2.0]), (2, [1e-320, 0.0]), (3, [1e300, -1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 1), (0, 3, 2), (0, 4, 3)]
    assert got[0][3] == 1.0 and got[3][3] == pytest.approx(inf)
    assert nearest.nearest(df.limit(0), F.lit(True)).collect() == []
    assert nearest.nearest(df.where("vec_id = 0"), F.lit(True)).collect() == []


def test_more_ties_than_places(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0, k=3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert {q: [v for _, v in sorted(x)] for q, x in got.items()} == {0: [1, 2, 3], 10: [0, 1, 2], 20: [0, 1, 2], 30: [0, 1, 2], 40: [0, 1, 2]}


def test_repeated_rows_of_a_query_take_no_places(spark):
    rows = [(0, [1.0, 2.0])] * 6 + [(1, [1.0, 2.0])] * 2 + [(i, [1.0, 2.0]) for i in range(2, 6)] + [(9, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = sorted((r.rank, r.vec_id, r.score) for r in nearest.nearest(df, F.col("vec_id") == 0, k=4).collect())
    assert got == [(1, 1, 0.0), (2, 1, 0.0), (3, 2, 0.0), (4, 3, 0.0)]
