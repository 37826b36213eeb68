"""One very long text among short ones, for the operators whose own tests have none."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from quillvec.llm import licences, packing, passages, pii, quotes, simhash, suffixes

PATH = public_tokenizers.path("word_bpe_49k.json")


def long_text():
    random.seed(8)
    return " ".join("w%d" % random.randint(0, 10**6) for _ in range(40_000))


def test_long_text(spark):
    text = long_text()
    words = text.split()
    df = spark.createDataFrame([(1, text), (2, "a b c"), (3, " ".join(words[20_000:20_200])), (4, text)], "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert groups[1] == groups[4] == 1 and groups[2] == 2
    assert sorted(r.doc_id for r in simhash.distinct(df).collect()) == [1, 2, 3]
    found = {r.doc_id: (r.source, r.start, r.end, r.source_start) for r in passages.repeats(df).collect()}
    assert found[4] == (1, 0, 40_000, 0) and found[3][:3] == (1, 0, 200) and found[3][3] == 20_000 and set(found) == {3, 4}
    rest = {r.doc_id: (r.n_bytes, len(r.rest)) for r in suffixes.dedup(df, 100).collect()}
    assert rest[1] == (len(text), len(text)) and rest[4] == (len(text), 0) and rest[3][1] == 0 and rest[2] == (5, 5)
    pieces = [r.length for r in packing.pieces(df, PATH, 2048).collect() if r.doc_id == 1]
    assert sum(pieces) == len(Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids) + 1 and max(pieces) == 2048


def test_long_runs_of_short_patterns(spark):
    """Texts of which a regular expression with a repeated group would recurse too deep."""
    n = 50_000
    runs = ["x@" + "a." * n + "com", "licence " + "a-" * n, "> " * n + "x", ">" * n, "licence " + "1." * n, "+1" + " 11" * n, "\n" * n, " \n\n" * n + "y", "Mr " + "A-" * n, "1" * n, "token=" + "a1" * n, "DE12" + " ABCD" * n, "on " + "a " * n + "wrote:", "(((" * n, "9." * n]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(runs)], "doc_id long, text string").repartition(4)
    made = {r.doc_id: r for r in pii.replace(docs, "k").collect()}
    assert len(made) == len(runs) and [p.kind for p in made[0].pii] == ["email"] and len(made[0].text) == len(runs[0]) and made[10].text != runs[10]
    files = docs.selectExpr("concat('a/b', doc_id, '/LICENSE') AS path", "text", "doc_id")
    assert licences.scan(files, keep=["doc_id"]).count() == len(runs)
    talk = quotes.thread(docs.selectExpr("doc_id AS conv_id", "0L AS turn", "'user' AS role", "text"))
    texts = {r.conv_id: r.text for r in talk.collect()}
    assert texts[2] == texts[3] == "" and texts[1] == runs[1] and texts[6] == runs[6]
