import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillvec.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def used(counts, limit, patterns):
    got = {}
    for runs, times in patterns:
        assert times > 0 and sum(x * m for x, m in runs) <= limit
        for x, m in runs:
            got[x] = got.get(x, 0) + m * times
    assert got == {k: v for k, v in counts.items() if v}
    return sum(times for _, times in patterns)


def optimum(items, limit):
    """The least number of sequences, by trying everything."""
    best = len(items)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(items):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - items[i]])
        go(i + 1, [*rooms, limit - items[i]])

    go(0, [])
    return best


def test_small_cases_are_optimal():
    random.seed(1)
    hits = 0
    for _ in range(120):
        items = sorted((random.randint(1, 20) for _ in range(random.randint(0, 8))), reverse=True)
        counts = {x: items.count(x) for x in items}
        n = used(counts, 20, packing.complete(counts, 20))
        least = optimum(items, 20)
        assert packing.lower_bound(counts, 20) <= least <= n <= used(counts, 20, packing.best_fit(counts, 20))
        hits += n == least
    assert hits >= 118


def test_never_worse_than_best_fit_and_near_the_bound():
    random.seed(2)
    counts = {}
    for _ in range(30_000):
        x = min(2048, max(1, int(random.lognormvariate(6.3, 1))))
        counts[x] = counts.get(x, 0) + 1
    n = used(counts, 2048, packing.complete(counts, 2048))
    assert n <= used(counts, 2048, packing.best_fit(counts, 2048))
    assert n <= packing.lower_bound(counts, 2048) * 1.001 + 1


def test_wrong_lengths():
    for bad in ({0: 1}, {11: 1}):
        with pytest.raises(ValueError):
            packing.complete(bad, 10)


def laid_out(rows, limit):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_rows_get_places(spark):
    random.seed(3)
    rows = [(i, random.choice([7, 7, 7, 3, 9, 1]), i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, length long, _bucket long").withColumn("offset", F.lit(-1))
    got = packing.pack(df, ["id"], 10)
    assert got.columns == ["id", "length", "_bucket", "sequence_id", "offset"]
    out = got.collect()
    assert len(out) == 500
    n = laid_out(out, 10)
    assert n == sum(t for _, t in packing.complete({k: sum(r[1] == k for r in rows) for k in {r[1] for r in rows}}, 10))


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, 4)] * 50, "id long, length long")
    assert laid_out(packing.pack(df, ["id"], 10).collect(), 10) == 25
    assert packing.pack(df.limit(0), ["id"], 10).collect() == []


def test_pieces(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", 1), (2, None, 2), (None, "", 3), (2, "the", 4)], "doc_id long, text string, piece int")
    got = packing.pieces(df, PATH, 3).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, len(r.ids)))
    assert sorted(by[1]) == [(0, 0, 3, 12), (1, 3, 3, 12), (2, 6, 1, 4)]
    assert sorted(by[2]) == [(0, 0, 1, 4), (0, 0, 2, 8)] and by[None] == [(0, 0, 1, 4)]
    assert all(r.ids.endswith(b"\0\0\0\0") for r in got if (r.doc_id, r.piece) == (1, 2))
