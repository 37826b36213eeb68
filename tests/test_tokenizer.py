import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillvec.operators import embed
from quillvec.operators.tokenizer import PART_BYTES, Pieces, TokenizerModel, explode_tokens, parts, register_udtf

META = TokenizerModel.from_vocab({"▁hello": 1, "▁he": 2, "lo": 3, "l": 4, "▁": 5, "<unk>": 0}, "Metaspace", "▁", "<unk>")
WORD = TokenizerModel.from_vocab({"unaff": 2, "un": 3, "##aff": 4, "##able": 5, "[UNK]": 1}, "WordPiece", "##", "[UNK]")
SHARP = TokenizerModel.from_vocab({"unaff": 2, "un": 3, "##aff": 4, "##able": 5, "[UNK]": 1, "#": 6}, "WordPiece", "##", "[UNK]")
U, W = "<unk>", "[UNK]"
CASES = [
    (META, "hello", ["▁hello"]), (META, "hellow", ["▁hello", U]), (META, "hel", ["▁he", "l"]), (META, "xy", ["▁", U, U]), (META, "é😀", ["▁", U, U]),
    (META, "  \n", []), (META, "", []), (META, None, []), (META, "a　b", ["▁", U, U, U]),
    (WORD, "unaffable", ["unaff", "##able"]), (WORD, "unx", ["un", W]), (WORD, "able", [W] * 4), (SHARP, "unx", ["un", W]), (WORD, "un un", ["un", "un"]),
]


@pytest.mark.parametrize("strategy", ["regex", "trie"])
def test_fixtures(spark, strategy):
    for model in (META, WORD, SHARP):
        mine = [(t, want) for m, t, want in CASES if m is model]
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(mine)], "i int, t string")
        got = df.select("i", model.tokenize("t", strategy).alias("x")).orderBy("i").collect()
        for r, (text, want) in zip(got, mine, strict=True):
            assert [x.key for x in r.x] == want, text
            assert [x.id for x in r.x] == [model.vocab.get(k, model.unk_id) for k in want]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="helo wunafb#▁😀é\t", max_size=30), min_size=1, max_size=5))
def test_strategies_agree(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for model in (META, WORD):
        rows = df.select("i", model.tokenize("t", "regex").alias("a"), model.tokenize("t", "trie").alias("b")).collect()
        for r in rows:
            plain = model.tokens(texts[r.i])
            assert [tuple(x) for x in r.a] == [tuple(x) for x in r.b] == plain


def test_documented_example(spark):
    pieces = "_J et _makers _fe ud _over _seat _width _with _big _orders _at _stake".split()
    model = TokenizerModel.from_vocab({p: i for i, p in enumerate(pieces)}, "Metaspace", "_")
    assert [k for k, _ in model.tokens("Jet makers feud over seat width with big orders at stake")] == pieces


def test_load(tmp_path):
    path = tmp_path / "tokenizer.json"
    path.write_text(json.dumps({"decoder": {"type": "WordPiece", "prefix": "##"}, "model": {"unk_token": "[UNK]", "vocab": {"[UNK]": 9, "a": 1}}}))
    model = TokenizerModel.load(str(path))
    assert (model.kind, model.prefix, model.unk_id) == ("WordPiece", "##", 9)
    for bad in ({"model": {"vocab": {}}}, {"decoder": {"type": "Metaspace"}, "model": {"unk_token": "x", "vocab": {}}}, {"decoder": {"type": "Metaspace"}, "model": {"vocab": [["a", 0.1]]}}, {"decoder": {"type": "ByteLevel"}, "model": {"vocab": {}}}):
        path.write_text(json.dumps(bad))
        with pytest.raises(ValueError):
            TokenizerModel.load(str(path))
    path.write_text(json.dumps({"decoder": {"type": "ByteLevel"}, "model": {"vocab": {"##a": 1}}}))
    assert TokenizerModel.load(str(path), compat="legacy").tokens("a") == [("##a", 1)]


def test_default_unknown_ids():
    assert TokenizerModel.from_vocab({}, "WordPiece").unk_id == 1 and TokenizerModel.from_vocab({}, "Metaspace").unk_id == 0


def test_explode_and_table_function(spark):
    df = spark.createDataFrame([(7, "hello xy")], "doc_id int, text string")
    assert [(r.pos, r.key) for r in explode_tokens(df, META).orderBy("pos").collect()] == [(0, "▁hello"), (1, "▁"), (2, U), (3, U)]
    register_udtf(spark, "pieces", META)
    assert [r.key for r in spark.sql("select * from pieces('hel')").collect()] == ["▁he", "l"]


def test_texts_come_in_parts_of_bounded_bytes():
    for given in ([], [None], ["", None, ""], ["ab", None, "é" * 9, "", "c", "x" * 40, "d", "e"], ["x" * 99]):
        texts = pa.array(["skipped", *given], pa.string()).slice(1)
        made = list(parts(iter([texts]), 12))
        assert [t for p in made for t in p.to_pylist()] == given and (made or not given)
        assert all(len(p) == 1 or sum(len(t.encode()) for t in p.to_pylist() if t) <= 12 for p in made)


def _in_parts(model):
    """A batch's tokens come in parts, and never does more than one part's take room."""
    text = "hello unaffable xy " * 500
    texts = pa.array([text] * (8 * PART_BYTES // len(text)))
    before, most, n, its = pa.total_allocated_bytes(), 0, 0, Pieces(model.spec())
    for made in its.tokens(iter([texts])):
        most, n = max(most, pa.total_allocated_bytes() - before), n + len(made)
        assert [tuple(x.values()) for x in made[0].as_py()[:40]] == model.tokens(text)[:40]
    assert n == len(texts) and 0 < most < 16 * PART_BYTES  # all at once take 25 times and 50 times PART_BYTES here


def test_wordpiece_tokens_of_a_large_batch_take_bounded_memory():
    _in_parts(WORD)


def test_metaspace_tokens_of_a_large_batch_take_bounded_memory():
    _in_parts(META)


def test_embed(spark):
    model = TokenizerModel.from_vocab({"a": 1, "b": 3, "c": 9, "<unk>": 0}, "Metaspace", "", "<unk>")
    weights = spark.createDataFrame([(0, [0.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 4.0]), (4, [4.0, 4.0])], "token_id int, vector array<double>")
    df = spark.createDataFrame([(1, "abbc"), (2, "c"), (3, None), (4, "z")], "doc_id int, text string")
    for most in (1 << 26, 0):  # broadcast and shuffled
        got = {r.doc_id: r.vector for r in embed.embed(df, model, weights, broadcast_bytes=most).collect()}
        assert [round(x, 6) for x in got[1]] == [0.666667, 2.666667] and got[2] is None and got[3] is None and got[4] == [0.0, 0.0]


def test_matrix_is_broadcast_only_under_its_bound(spark):
    weights = spark.createDataFrame([(0, [0.0])], "token_id int, vector array<double>")
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [embed.embed(df, META, weights, broadcast_bytes=b).select(F.count("*"))._jdf.queryExecution().toString() for b in (1 << 20, 0)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in plans[0] and "Join" in plans[1] and "strategy=broadcast" not in plans[1]


def test_means_of_both_ways_agree(spark):
    weights = spark.createDataFrame([(i, [float(i), 1.0 / (i + 1)]) for i in range(0, 40, 3)], "token_id int, vector array<double>")
    df = spark.createDataFrame([(1, "the house of and in"), (2, None), (3, ""), (4, "xyzzy the the the" * 50), (5, "日本")], "doc_id int, text string")
    model = TokenizerModel.from_vocab({p: i for i, p in enumerate(["<unk>", "▁", "▁the", "▁of", "t", "h", "e", "o", "x", "y"])}, "Metaspace", "▁", "<unk>")
    near, far = ({r.doc_id: r.vector for r in embed.embed(df, model, weights, broadcast_bytes=b).collect()} for b in (1 << 20, 0))
    assert set(near) == set(far) and all((near[d] is None) == (far[d] is None) for d in near)
    assert all(abs(x - y) < 1e-12 for d in near if near[d] for x, y in zip(near[d], far[d], strict=True))
    assert near[2] is near[3] is None and near[4] is not None


def test_only_weights_that_the_vocabulary_names_count_for_the_bound(spark):
    weights = spark.range(5000).select(F.col("id").cast("int").alias("token_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vector"))
    df = spark.createDataFrame([(1, "hello"), (2, "l"), (3, "x"), (4, None)], "doc_id int, text string")
    made = embed.embed(df, META, weights, broadcast_bytes=6 * 16)
    assert "Join" not in made._jdf.queryExecution().toString()
    assert {r.doc_id: r.vector for r in made.collect()} == {1: [1.0, 1.0], 2: [4.5, 1.0], 3: [2.5, 1.0], 4: None}


def test_tokens_may_be_summed_in_the_select_that_makes_them(spark):
    df = spark.createDataFrame([("hello xy",), (None,), ("l",)], "t string")
    assert df.select(F.sum(F.size(META.tokenize("t"))).alias("n")).first().n == 6
