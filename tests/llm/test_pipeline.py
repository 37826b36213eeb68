import random

import pytest

import corpus_pipeline
from quillvec.llm import packing


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(1)
    word = lambda: "w%d" % random.randint(0, 50_000)
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(i, text(80), "en", "s", 0) for i in range(60)]
    copied, passage = text(200), text(70)
    rows += [(100, copied, "en", "s", 0), (101, copied, "de", "t", 0), (102, copied.replace(" ", "  ", 3) + " end", "en", "s", 0)]
    rows += [(110, text(60) + " " + passage, "en", "s", 0), (111, passage + " " + text(60), "en", "s", 0)]
    rows += [(120, text(60) + " ann.lee@mail.example.com 97.51.17.173", "en", "s", 0), (130, "short", "en", "s", 0), (131, None, None, None, None), (132, "from " * 400, "en", "s", 0)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return f"file://{path}", {r[0]: r for r in rows}


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "PII", "best-fit packing"]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = corpus_pipeline.durable(stage(spark, docs, path))
        assert docs.columns == before
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(rows) - set(kept[0]) == {130, 131, 132}
    assert set(kept[0]) - set(kept[1]) == {101, 102}
    assert kept[2][110].text == rows[110][1] and kept[2][111].text == " ".join(rows[111][1].split()[70:]) and set(kept[2]) == set(kept[1])
    changed = {d for d in kept[3] if kept[3][d].text != kept[2][d].text}
    assert changed == {120} and "ann.lee" not in kept[3][120].text and "97.51" not in kept[3][120].text
    assert all(r.n_chars == len(r.text) for r in kept[3].values())
    for d in range(60):
        assert kept[3][d].text == rows[d][1]  # clean documents stay as they are


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder[0]).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({r.doc_id for r in got}) == 64
    lengths = [r.length for r in got]
    counts = {x: lengths.count(x) for x in lengths}
    assert packing.lower_bound(counts, 2048) <= len(by) <= sum(n for _, n in packing.best_fit(counts, 2048))


def test_empty_documents(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []
