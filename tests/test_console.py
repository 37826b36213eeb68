from quillvec.operators.store import VectorStore
from quillvec.operators.tokenizer import TokenizerModel
from quillvec.sources.synthetic import random_vectors
from quillvec.streaming import console


def test_answers(spark, tmp_path):
    model = TokenizerModel.from_vocab({"cat": 1, "dog": 2, "<unk>": 0}, "Metaspace", "", "<unk>")
    weights = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "token_id int, vector array<double>")
    store = VectorStore(spark, f"{tmp_path}/s", 2)
    store.add(spark.createDataFrame([(0, [1.0, 0.1], "about cats\nmore"), (1, [0.1, 1.0], "about dogs")], "o int, vector array<double>, text string"), text="text", order="o")
    assert list(console.answers(spark, ["cat\n", "dog dog cat\n", "what\n", "\n", "cat"], store, model, weights)) == ["about cats\n", "about dogs\n", ""]
    assert console.show(store.search([1.0, 0.1], 2)) == "0\t1.000\tdb/0.txt\n1\t0.198\tdb/1.txt\n"


def test_random_vectors(spark):
    a = {r.id: r.vector for r in random_vectors(spark, 50, 8, seed=3).collect()}
    b = {r.id: r.vector for r in random_vectors(spark, 50, 8, seed=3, partitions=7).collect()}
    c = {r.id: r.vector for r in random_vectors(spark, 50, 8, seed=4).collect()}
    assert a == b != c and all(len(v) == 8 and all(-1 <= x < 1 for x in v) for v in a.values())
    mean = sum(sum(v) for v in a.values()) / 400
    assert abs(mean) < 0.15 and random_vectors(spark, 3, 0).first().vector == []
