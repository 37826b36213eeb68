import pytest

from quillvec.operators import store as store_module
from quillvec.operators.store import VectorStore, numbered
from quillvec.sources import binary
from quillvec.streaming import serve


def batch(spark, rows):
    return spark.createDataFrame(rows, "o int, vector array<double>, text string")


ROWS = [(0, [1.0, 0.0], "zero\nmore"), (1, [0.0, 2.0], "one"), (2, [1.0, 1.0], "two")]


def test_lifecycle(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    assert store.count() == 0 and store.current_id() == 0 and store.search([1, 0], 3).collect() == []
    assert store.add(batch(spark, ROWS), text="text", order="o") == 0
    assert store.current_id() == 3 and [r.id for r in store.search([1, 0], 2).collect()] == [0, 2]
    assert store.entries().where("id = 1").first().vector == [0.0, 1.0] and store.entries().where("id = 1").first().file_path == "db/1.txt"
    assert store.delete(1) and store.count() == 2 and store.current_id() == 3 and not store.delete(99)
    assert store.add(batch(spark, [(0, [0.0, 1.0], "three"), (1, [1.0], "bad"), (2, None, "bad")]), text="text", order="o") == 2
    assert sorted(r.id for r in store.entries().collect()) == [0, 2, 3] and store.current_id() == 4
    assert store.search_text([1, 0], 2) == "zero\ntwo\n" and store.search_text([1], 2) == ""


def test_save_and_load(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, ROWS), order="o")
    store.save(f"{tmp_path}/saved")
    other = VectorStore(spark, f"{tmp_path}/b", 2)
    other.load(f"{tmp_path}/saved")
    key = lambda s: sorted((r.id, tuple(r.vector)) for r in s.entries().collect())
    assert key(other) == key(store) and other.current_id() == 3
    wrong = VectorStore(spark, f"{tmp_path}/c", 3)
    wrong.add(spark.createDataFrame([([1.0, 0.0, 0.0],)], "vector array<double>"))
    with pytest.raises(ValueError):
        wrong.load(f"{tmp_path}/saved")
    assert wrong.count() == 1


def test_next_id_never_falls(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 1)
    store.next_id = 20
    store.load_entries(spark.createDataFrame([(0, [1.0], "p"), (7, [1.0], "q")], "id int, vector array<float>, file_path string"))
    assert store.current_id() == 20
    fresh = VectorStore(spark, f"{tmp_path}/b", 1)
    fresh.load_entries(store.entries())
    assert fresh.current_id() == 8


def test_index_prunes_and_goes_stale(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0], None) for i in range(40)]), order="o")
    assert store.stale
    got = [r.id for r in store.search_clustered([1.0, 0.0], 5).collect()]
    assert not store.stale and len(store.centroids) == 6 and set(got) <= set(range(1, 40, 2))
    plan = store.search_clustered([1.0, 0.0], 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster_id" in plan
    store.build_index(compat="legacy")
    assert [r.id for r in store.search_clustered([1.0, 0.0], 5).collect()] == [r.id for r in store.search([1.0, 0.0], 5).collect()]


def test_identical_vectors(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, [(i, [1.0, 2.0], f"t{i}") for i in range(3)]), text="text", order="o")
    assert [r.id for r in store.search([1.0, 2.0], 2).collect()] == [0, 1]


def test_files(spark, tmp_path):
    binary.register(spark)
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, ROWS), text="text", order="o")
    store.export(f"{tmp_path}/s.bin")
    other = VectorStore(spark, f"{tmp_path}/b", 2)
    other.load_entries(spark.read.format("vecbin").load(f"{tmp_path}/s.bin"))
    assert other.count() == 3 and other.current_id() == 3
    store.export_texts(f"{tmp_path}/db")
    assert (tmp_path / "db" / "0.txt").read_text() == "zero\nmore"


def test_streams(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    batch(spark, ROWS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("o int, vector array<double>, text string").parquet(f"{tmp_path}/in")
    q = serve.ingest(stream, store, f"{tmp_path}/c1", "text", "o")
    q.processAllAvailable()
    q.stop()
    assert store.count() == 3
    answers = []
    asked = spark.readStream.schema("o int, vector array<double>, text string").parquet(f"{tmp_path}/in").withColumnRenamed("o", "query_id")
    q = serve.serve(asked, store.entries(), 1, lambda df, i: answers.extend(df.collect()), f"{tmp_path}/c2")
    q.processAllAvailable()
    q.stop()
    assert sorted((r.query_id, r.id) for r in answers) == [(0, 0), (1, 1), (2, 2)]
    q = serve.scored(asked, store.entries(), at_least=0.99).writeStream.format("memory").queryName("scored").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.query_id, r.id) for r in spark.table("scored").collect()) == [(0, 0), (1, 1), (2, 2)]


def test_open_again_and_append(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, ROWS), text="text", order="o")
    store.delete(0)
    before = {f for f in (tmp_path / "a" / "data").rglob("*.parquet")}
    again = VectorStore(spark, f"{tmp_path}/a", 2)
    assert again.count() == 2 and again.current_id() == 3 and again.stale
    again.add(batch(spark, ROWS[:1]), order="o")
    assert before < {f for f in (tmp_path / "a" / "data").rglob("*.parquet")}  # nothing is written anew
    last = VectorStore(spark, f"{tmp_path}/a", 2)
    assert sorted(r.id for r in last.entries().collect()) == [1, 2, 3] and last.current_id() == 4
    with pytest.raises(ValueError):
        VectorStore(spark, f"{tmp_path}/a", 3)
    with pytest.raises(Exception):  # noqa: B017  the other writer was first
        store.delete(1)
    assert VectorStore(spark, f"{tmp_path}/a", 2).count() == 3


def test_facts_that_were_cut_off(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, ROWS), order="o")
    (tmp_path / "a" / "facts" / f"{store.number + 1:012d}.json").write_text('{"dim": 2, "par')
    assert VectorStore(spark, f"{tmp_path}/a", 2).count() == 3


def test_many_deletes_are_applied(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MARKS", 2)
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, ROWS), order="o")
    assert store.delete(0) and store.deleted == [0] and store.delete(2) and store.deleted == []
    assert [r.id for r in store.entries().collect()] == [1] and store.current_id() == 3
    store.build_index()
    assert VectorStore(spark, f"{tmp_path}/a", 2).centroids == store.centroids


def test_batches_are_added_once(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    for _ in range(2):
        store.add(batch(spark, ROWS), order="o", once=("stream", 0))
    again = VectorStore(spark, f"{tmp_path}/a", 2)
    again.add(batch(spark, ROWS), order="o", once=("stream", 0))
    again.add(batch(spark, ROWS[:1]), order="o", once=("stream", 1))
    assert again.count() == 4


def test_numbers_follow_the_order(spark, monkeypatch):
    monkeypatch.setattr(store_module, "BUCKET", 50)
    for n, rows in ((12_000, spark.range(12_000).selectExpr("id * 7919 % 12000 AS o")), (5_000, spark.range(5_000).selectExpr("CAST(id % 3 AS STRING) AS o"))):
        got, total = numbered(rows.repartition(5), "o", rows)
        found = [(r._n, r.o) for r in got.collect()]
        assert total == n and sorted(x for x, _ in found) == list(range(n))
        assert [o for _, o in sorted(found)] == sorted(o for _, o in found)
    got, total = numbered(rows.limit(0), "o", rows.limit(0))
    assert total == 0 and got.collect() == []


def test_batches_of_queries(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/a", 2)
    store.add(batch(spark, [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0], None) for i in range(40)]), order="o")
    asked = spark.createDataFrame([(7, [1.0, 0.05]), (8, [0.0, 3.0])], "query_id long, vector array<double>")
    for clustered, one in ((False, store.search), (True, store.search_clustered)):
        got = {(r.query_id, r.rank): r.id for r in store.search_batch(asked, 3, clustered).collect()}
        assert got == {(q, i + 1): r.id for q, v in ((7, [1.0, 0.05]), (8, [0.0, 3.0])) for i, r in enumerate(one(v, 3).collect())}
    assert not store.stale
