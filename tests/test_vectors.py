import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.functions import text, vectors
from quillvec.operators import cluster, embed, search


def frame(spark, rows):
    return spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "id int, vector array<double>")


def test_normalize(spark):
    rows = [[1.0, 1.0, 1.0], [0.0, 0.0, 0.0], [3.0, 4.0], [float("nan"), 1.0], None, []]
    got = [r[0] for r in frame(spark, rows).orderBy("id").select(vectors.l2_normalize("vector")).collect()]
    assert np.allclose(got[0], 0.577350, atol=1e-6) and got[1] == [0, 0, 0] and np.allclose(got[2], [0.6, 0.8])
    assert math.isnan(got[3][0]) and got[3][1] == 1.0 and got[4] is None and got[5] == []


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), (None, [1.0]), ([], [])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(vectors.dot("a", "b")).collect()] == [11.0, None, 0.0, 0.0]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.floats(-100, 100), min_size=3, max_size=3), min_size=1, max_size=8))
def test_mean_and_norm_against_numpy(spark, rows):
    df = frame(spark, rows).withColumn("g", F.lit(1))
    got = embed.mean_vector(df, ["g"]).first().vector
    assert np.allclose(got, np.mean(rows, axis=0), atol=1e-9)
    for r, v in zip(rows, [x[0] for x in df.orderBy("id").select(vectors.l2_normalize("vector")).collect()], strict=True):
        n = np.sqrt(np.sum(np.square(r)))
        assert np.allclose(v, np.array(r) / n if n > 0 else r, atol=1e-9)


def test_means(spark):
    assert embed.mean_vector(frame(spark, [[3.0, 2, 3], [1, 5, 6], [5, 8, 9]]).withColumn("g", F.lit(0)), ["g"]).first().vector == [3, 5, 6]
    assert embed.mean_vector(frame(spark, [[2.0] * 8] * 16).withColumn("g", F.lit(0)), ["g"]).first().vector == [2.0] * 8
    assert embed.mean_vector(frame(spark, []).withColumn("g", F.lit(0)), ["g"]).collect() == []


def test_block_mean(spark):
    got = [r[0] for r in frame(spark, [[1.0, 2, 3, 4, 5, 6, 7, 8, 9], [1.0], None]).orderBy("id").select(vectors.block_mean("vector", 4)).collect()]
    assert got == [[2.5, 6.5], [], None]


def test_strings(spark):
    df = frame(spark, [[1.0, 0.5, 1 / 3, 1e-7, 123456789.0], None])
    assert [r[0] for r in df.orderBy("id").select(vectors.vector_to_string("vector")).collect()] == ["[1, 0.5, 0.333333, 1e-07, 1.23457e+08]", None]
    assert df.where("id = 0").select(vectors.matrix_to_string(F.array("vector", "vector"))).first()[0].count("[") == 3


def test_text_functions(spark):
    df = spark.createDataFrame([("a b c　d\te\x0bf\nend\r",)], "t string")
    r = df.select(text.words("t"), text.first_line("t"), text.without_newlines("t"), text.without_return("t"), text.hex_dump("t", 3), text.entry_path("db/", F.lit(7))).first()
    assert r[0] == ["a b", "c　d", "e", "f", "end"] and r[1] == "a b c　d\te\x0bf"
    assert "\n" not in r[2] and not r[3].endswith("\r") and r[4] == "61C2A0" and r[5] == "db/7.txt"


ACCURACY = [(0, [1.0, 1.0, 1.0]), (1, [1.0, 1.0, -1.0]), (2, [1.0, -1.0, 1.0]), (3, [1.0, -1.0, -1.0]), (4, [1.0, -1.0, 0.0]), (5, [1.0, 1.0, 0.0])]


def test_exact_search(spark):
    df = spark.createDataFrame(ACCURACY, "id int, vector array<double>")
    got = [(r.id, round(r.similarity, 6)) for r in search.knn_exact(df, [1, 1, -1], 100, digits=9).collect()]
    assert got == [(1, 1.0), (5, 0.816497), (0, 0.333333), (3, 0.333333), (4, 0.0), (2, -0.333333)]
    assert [r.id for r in search.knn_exact(df, [1, 1, -1], 1).collect()] == [1]
    assert search.knn_exact(df, [1, 1, -1], 0).collect() == [] and search.knn_exact(df, [1, 1], 3).collect() == []
    try:
        search.knn_exact(df, [1, 1, -1], -1)
    except ValueError:
        pass
    else:
        raise AssertionError("a negative k must be refused")


def test_search_is_a_bounded_sort(spark):
    plan = search.knn_exact(spark.createDataFrame(ACCURACY, "id int, vector array<double>"), [1, 1, -1], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_ties_and_nan(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (0, [float("nan"), 1.0])], "id int, vector array<double>")
    assert [r.id for r in search.knn_exact(df, [1, 0], 3).collect()] == [1, 2, 0]


def test_joined_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    e, q = rng.normal(size=(300, 8)), rng.normal(size=(23, 8))
    e[17] = e[200]
    entries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)] + [(900, [1.0]), (901, None)], "id long, vector array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vector array<double>")
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (e / np.linalg.norm(e, axis=1, keepdims=True)).T, 9)
    want = {(i, r + 1): int(j) for i in range(23) for r, j in enumerate(np.lexsort((np.arange(300), -sims[i]))[:7])}
    for block in (4096, 5):
        got = {(r.query_id, r.rank): r.id for r in search.knn_join(queries, entries, 7, query_block=block, digits=9).collect()}
        assert got == want
    assert search.knn_join(queries, entries, 0).collect() == [] and search.knn_join(queries.limit(0), entries, 3).collect() == []


def test_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(size=5) * 0.1 + np.eye(5)[i % 3]).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, vector array<double>")
    centroids = cluster.fit(df, k=3)
    homes = {r.id: r.cluster_id for r in search.with_cluster(df, centroids).collect()}
    assert len({(i % 3, homes[i]) for i in homes}) == 3
    stored = search.with_cluster(df, centroids)
    exact = [r.id for r in search.knn_exact(df, rows[0][1], 60).collect()]
    near = [r.id for r in search.knn_clustered(stored, centroids, rows[0][1], 60).collect()]
    assert near == [i for i in exact if homes[i] == homes[0]]
    # One cluster holds all: the pruned search is the exact one.
    one = cluster.fit(df, k=1)
    assert [r.id for r in search.knn_clustered(search.with_cluster(df, one), one, rows[5][1], 9).collect()] == [r.id for r in search.knn_exact(df, rows[5][1], 9).collect()]
    legacy = cluster.fit(df, k=3, compat="legacy")
    assert {r.cluster_id for r in search.with_cluster(df, legacy).collect()} == {0}


def test_both_engines_agree(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=7).tolist()) for i in range(200)] + [(200, [0.0] * 7), (201, None), (202, [])]
    df = spark.createDataFrame(rows, "id int, vector array<double>").repartition(3)
    for r in df.select(vectors.l2_normalize("vector").alias("a"), vectors.l2_normalize_batches("vector").alias("b")).collect():
        assert r.a is None and r.b is None or np.allclose(r.a, r.b, atol=1e-12)
    unit = df.where("id < 200").select("id", vectors.l2_normalize("vector").alias("vector"))
    centroids = cluster.seeds(unit, 4)
    a = cluster.update(cluster.assign(unit, centroids), centroids)
    b = cluster.step(unit.select("vector"), centroids)
    assert np.allclose(a, b, atol=1e-9)
    assert np.allclose(cluster.fit(df, 4, 1), a, atol=1e-9)


def test_empty_clusters_keep_their_centroid(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.9, 0.1])], "id int, vector array<double>")
    centroids = [[1.0, 0.0], [-1.0, 0.0]]
    assert cluster.update(cluster.assign(df, centroids), centroids)[1] == [-1.0, 0.0]
    assert cluster.fit(df.limit(0)) == [] and len(cluster.seeds(df, 6)) == 2


def test_search_text(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "first\nmore"), (1, [0.0, 1.0], "second"), (2, [1.0, 0.1], None)], "id int, vector array<double>, text string")
    assert search.search_text(df, [1, 0], 3) == "first\nsecond\n" and search.search_text(df, [], 3) == ""
