import random

import numpy as np
import pytest

from quillvec.llm import suffixes


def test_suffix_array():
    random.seed(1)
    for _ in range(600):
        letters = random.choice([1, 2, 3, 20])
        x = [random.randint(0, letters) for _ in range(random.randint(0, 45))]
        assert suffixes.suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])
    fibonacci = [0]
    for a, b in [(0, 1)]:
        u, v = [a], [b]
        for _ in range(11):
            u, v = v, v + u
        fibonacci = v
    assert suffixes.suffix_array(np.array(fibonacci)).tolist() == sorted(range(len(fibonacci)), key=lambda i: fibonacci[i:])


@pytest.mark.parametrize("size", [3, 20, 40, 100])
def test_runs_cover_each_window_once_and_follow_their_content(size):
    random.seed(size)
    texts = ["".join(random.choice("abcd") for _ in range(random.randint(0, 400))).encode() for _ in range(30)]
    texts += [texts[0][:300] + b"x" + texts[1], b"a" * 250, b"", b"ab" * 100]
    doc, start, n, place, key = suffixes.runs(texts, size)
    seen, by = set(), {}
    for d, s, m, p, k in zip(doc.tolist(), start.tolist(), n.tolist(), place.tolist(), key.tolist(), strict=True):
        assert s <= p <= s + size
        for i in range(s, s + m):
            assert (d, i) not in seen
            seen.add((d, i))
            got = (k, p - i)  # equal windows have their minimizer at the same place
            assert by.setdefault(texts[d][i : i + size], got) == got
    assert len(seen) == sum(max(0, len(t) - size + 1) for t in texts)


def plain(rows, size):
    """Rest of each row, rows in order of (id, text)."""
    seen, out = set(), []
    for d, t in sorted(((d if d is not None else -(1 << 63)), t or "") for d, t in rows):
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i : i + size]
            if w in seen:
                gone[i : i + size] = b"\1" * size
            seen.add(w)
        spans, i = [], 0
        while i < len(b):
            j = i
            while j < len(b) and gone[j]:
                j += 1
            if j > i:
                spans.append((i, j))
            i = j + 1
        out.append((d, len(b), tuple(spans), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out)


def got(df, size, block=1 << 16):
    rows = suffixes.dedup(df, size, keep=["doc_id"], block=block).collect()
    return sorted((r.doc_id if r.doc_id is not None else -(1 << 63), r.n_bytes, tuple((s["start"], s["end"]) for s in r.spans), bytes(r.rest)) for r in rows)


def corpus():
    random.seed(9)
    text = lambda n: "".join(random.choice("abcdefgh éß\n") for _ in range(n))
    shared, line = text(400), text(130)
    rows = [(i, text(random.randint(0, 500))) for i in range(30)]
    rows += [(100 + i, text(50) + line + text(60)) for i in range(60)]  # one line, different surroundings
    rows += [(200 + i, shared[: random.randint(90, 400)] + text(5) + shared[random.randint(0, 300) :]) for i in range(40)]
    rows += [(300, shared), (300, shared), (301, shared + shared), (302, line * 4), (303, "a" * 700), (304, "ab" * 300), (305, "a" * 99), (306, None), (None, shared), (None, ""), (307, "é" * 300)]
    return rows


@pytest.mark.parametrize(("size", "block"), [(100, 1 << 16), (100, 60), (30, 500), (35, 1 << 16)])
def test_against_plain_windows(spark, size, block):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, doc int, _turn string").repartition(5)
    assert got(df, size, block) == plain(rows, size)


def test_small_batches(spark, monkeypatch):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert got(df, 100) == plain(rows, 100)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    df = spark.createDataFrame([(1, "x" * 50), (2, None)], "doc_id long, text string")
    assert got(df.limit(0), 100) == []
    assert got(df, 100) == plain([(1, "x" * 50), (2, None)], 100)
