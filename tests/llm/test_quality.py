import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillvec.llm import quality


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(lines), n < 50 or 100 * len(covered) > 50 * n


def test_counts(spark):
    random.seed(1)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "a b c a b c", "x\r\ny\nx\r\n\n \nx", "Ünï 😀 # | <>", "the cat " * 2000]
    texts += ["".join(random.choice("ab c\n\x0b\x1c\xa0#") for _ in range(random.randint(0, 80))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r.doc_id: r for r in quality.counts(df).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.base_failed) == plain(t), t


def test_binomial_tail_is_exact(spark):
    cases = [(k, n, p) for n in (1, 5, 33, 200, 3000, 60_000) for k in {0, 1, 2, n // 200, n // 110, n // 50} if k <= n for p in (0.01, 0.05, 0.3)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for p in (0.01, 0.05, 0.3):
        for r in df.select("k", "n", quality.tail(F.col("k"), F.col("n"), p).alias("t")).distinct().collect():
            if r.k >= r.n * p:
                assert r.t == 1
                continue
            logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(p) + (r.n - i) * math.log(1 - p) for i in range(r.k + 1)]
            want = sum(map(math.exp, logs))
            assert r.t == pytest.approx(want, rel=1e-7, abs=1e-300)


def corpus(n=8000):
    """Good documents, and bad ones that are full of symbols; every fourth has no label."""
    random.seed(2)
    rows, labels = [], []
    for i in range(n):
        words = ["w%d" % random.randint(0, 5000) for _ in range(60)]
        bad = i % 5 == 0
        if bad:
            words = [w + random.choice(["###", "$$$"]) for w in words]
        rows.append((i, " ".join(words), "en" if i % 2 else None, "x"))
        if i % 4:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def test_cutoffs_and_their_guarantee(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.rules(docs, marks, keep=["doc_id"]).collect()
    assert all(r.kept == bool(r.doc_id % 5) for r in got) and len(got) == len(rows)
    counted = quality.counts(docs.drop("kept")).join(marks, "doc_id")
    found = quality.fit(counted).collect()
    assert {r.stratum for r in found} == {"", "en"} and all(r.bound <= 0.05 / 10 for r in found)
    # With few labels nothing can be promised, so only the base rules reject.
    few = quality.rules(docs, marks.where("doc_id < 400"), keep=["doc_id"])
    assert few.where("not kept").count() == 0


def test_a_cutoff_never_rejects_more_good_documents_than_allowed(spark):
    """Scores of good and bad documents overlap: over many drawn corpora the true rate stays under the limit."""
    random.seed(3)
    failures = 0
    rows = []
    for trial in range(40):
        for i in range(2500):
            good = random.random() < 0.8
            level = min(100, int(abs(random.gauss(5 if good else 15, 6))))
            rows.append((trial * 10_000 + i, f"t{trial}", int(good), 60, 100, level, 0, 0, 10, False))
    cols = "doc_id long, lang string, quality int, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, base_failed boolean"
    df = spark.createDataFrame(rows, cols)
    found = {r.stratum: r.cutoff for r in quality.fit(df, error=1.0, risk=0.25).where("rule = 'symbols'").collect()}
    random.seed(4)
    fresh = [min(100, int(abs(random.gauss(5, 6)))) for _ in range(100_000)]
    assert found
    for cutoff in found.values():
        failures += sum(x > cutoff for x in fresh) / len(fresh) > 0.05 + 0.01
    assert failures <= 2


def test_empty_tables_nulls_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, None, None), (None, "word " * 60, "en")], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.rules(docs, marks).collect()
    assert len(got) == 3 and not any(r.kept for r in got)
    assert quality.rules(docs.limit(0), marks).collect() == []
    assert quality.rules(docs, marks.limit(0)).count() == 3
