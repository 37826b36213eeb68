import os
import random

import numpy as np
import pytest
import xxhash

from quillvec.llm import simhash
from quillvec.llm.common import components


def plain(text, words=3):
    parts = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    parts = [p for p in __import__("re").findall(r"[^\x20\x09-\x0D]+", parts)]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def test_fingerprint():
    random.seed(1)
    for _ in range(300):
        text = "".join(random.choice("ab É\t\n\x0b\xa0cDE ") for _ in range(random.randint(0, 60)))
        assert simhash.fingerprint(text) == plain(text)
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def test_fingerprint_of_spark_hash(spark):
    h = spark.sql("select xxhash64('one two three') as h").first().h
    assert simhash.fingerprint("one two three") == h % (1 << 64)


def test_golay_code_is_perfect_and_lists_are_whole():
    _, patterns, n = simhash.golay()
    assert sorted(set(n.tolist())) == [1, 6] and (n == 6).sum() == 1771
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 200).astype(np.int32)
    codes = np.array([i for i in range(1 << 12)], np.int64)
    full = []
    for c in codes.tolist():  # codewords by their upper twelve bits
        w = c << 11
        r = w
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= simhash.GENERATOR << (i - 11)
        full.append(w | r)
    full = np.array(full)
    got, number = simhash.fuzzy(words)
    for w, g, m in zip(words.tolist(), got, number, strict=True):
        distance = np.bitwise_count(full ^ w)
        assert set(g[:m].tolist()) == set((full[distance <= 4] >> 11).tolist())
        assert distance[g[0]] <= 3


def test_keys_meet_within_three_bits():
    random.seed(2)
    for _ in range(400):
        a = random.getrandbits(64)
        b = a
        for bit in random.sample(range(64), random.randint(0, 3)):
            b ^= 1 << bit
        key, at, near = simhash.keys(np.array([a, b], np.uint64).view(np.int64))
        assert set(key[(at == 0) & near].tolist()) & set(key[at == 1].tolist())


def brute(prints, most=3):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def cluster_prints():
    """A crowded cluster, chains of 3 bits, and lone fingerprints."""
    random.seed(3)
    base = random.getrandbits(64)
    out = {base}
    for _ in range(150):
        v = base
        for bit in random.sample(range(12), random.randint(1, 6)):
            v ^= 1 << bit
        out.add(v)
    v = random.getrandbits(64)
    for step in range(6):
        out.add(v)
        for bit in range(3):
            v ^= 1 << (10 * step + bit)
    out |= {random.getrandbits(64) for _ in range(60)}
    return sorted(out)


def test_links_connect_what_brute_force_connects(spark):
    prints = cluster_prints()
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    want = brute(prints)
    df = spark.createDataFrame([(x,) for x in signed], "fingerprint long")
    for block in (1 << 14, 8):  # the second sends buckets to tasks block by block
        got = {r.node: r.component for r in components(simhash.links(df, 3, block)).collect()}
        have = [got.get(x, x) for x in signed]
        assert len(set(zip(want, have, strict=True))) == len(set(want)) == len(set(have))


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 60), random.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x
    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = {x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}
    assert got == {x: find(x) for x in nodes}


def test_near_duplicates(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(300)]
    base = [random.choice(words) for _ in range(400)]
    rows = [(9, " ".join(base)), (4, " ".join(base)), (4, " ".join(base)), (12, " ".join(base[:-1] + ["x"])), (1, None), (2, ""), (3, " \n"), (20, "alone"), (21, "ALONE"), (30, "Ü"), (31, "ü")]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "doc_id long, text string, fingerprint int, component_id string")
    got = simhash.near_duplicates(df).collect()
    prints = [plain(t or "") for _, t in rows]
    label = brute(prints)
    want = {}
    for (d, _), l in zip(rows, label, strict=True):
        want[l] = min(want.get(l, d), d)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{p:016x}", want[l]) for (d, _), p, l in zip(rows, prints, label, strict=True))
    assert simhash.near_duplicates(df.limit(0)).collect() == []


def test_distinct_keeps_one_of_each_confirmed_group(spark):
    random.seed(6)
    words = [f"word{i}" for i in range(500)]
    base = [random.choice(words) for _ in range(300)]
    other = [random.choice(words) for _ in range(300)]
    edited = list(base)
    edited[150] = "changed"
    mixed = sorted(base)  # the same words in another order: one fingerprint of single words, other shingles
    rows = [(5, " ".join(base)), (2, " ".join(edited)), (7, " ".join(base)), (7, " ".join(base)), (8, " ".join(other)), (9, " ".join(mixed)), (None, None), (11, ""), (12, "one")]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "doc_id long, text string, _doc int, _d int")
    got = simhash.distinct(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, rows[1][1]), (8, rows[4][1]), (9, rows[5][1]), (None, None), (12, "one")], key=str)
    assert simhash.distinct(df.limit(0)).collect() == []


def test_exact_copies_go_whatever_else_they_resemble(spark):
    """Texts of the same words in other orders share a fingerprint of single words; each order's copies go, the orders stay."""
    random.seed(9)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(200)]
    rows = []
    for i in range(12):
        random.shuffle(base)
        rows += [(3 * i + j, " ".join(base)) for j in range(3)]
    got = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 36, 3))


def test_near_copies_of_a_later_text_of_the_fingerprint_go(spark):
    """The same words in many orders share a fingerprint; a near copy of any of the orders goes, not only one of the smallest."""
    random.seed(10)
    base = [f"w{random.randint(0, 10**6)}" for _ in range(200)]
    orders = [random.sample(base, 200) for _ in range(12)]
    swapped = [[*o[:100], o[101], o[100], *o[102:]] for o in orders]
    rows = [(i, " ".join(o)) for i, o in enumerate(orders + swapped)]
    got = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted(r.doc_id for r in got) == list(range(12))


def test_sketches_never_rule_out_alike_sets():
    rng = np.random.default_rng(11)
    for _ in range(200):
        n = int(rng.integers(1, 60_000)) if _ % 10 == 0 else int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[int(len(a) * rng.uniform(0, 0.2)) :], rng.integers(0, 1 << 62, int(n * rng.uniform(0, 0.1))).astype(np.uint64))))
        x, y = (np.frombuffer(simhash.sketch(s), np.uint8).astype(int) for s in (a, b))
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def jaccard(a, b):
    x, y = set(simhash.shingles(a).tolist()), set(simhash.shingles(b).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def test_codewords_bridge_two_errors():
    rng = np.random.default_rng(12)
    words = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    for errors in (0, 1, 2):
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, errors, replace=False)) for _ in words], np.int32)
        (a, n), (b, m) = simhash.fuzzy(words), simhash.fuzzy(words ^ flips)
        assert all(set(x[:i].tolist()) & set(y[:j].tolist()) for x, i, y, j in zip(a, n, b, m, strict=True))


def prints_of(n, seed, crowd):
    """Rows (id, print, n): a crowd that differs in a few bits, pairs, and lone ones."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, 128)
    rows = []
    for i in range(n):
        v = base.copy() if i % 3 == 0 and crowd else rng.integers(0, 2, 128)
        v[rng.choice(115, 4, replace=False)] ^= 1
        rows.append(v)
        if i % 5 == 0:
            w = v.copy()
            w[rng.choice(115, 9, replace=False)] ^= 1
            rows.append(w)
    ids = rng.permutation(len(rows)) * 7 - 300
    packed = [np.packbits(np.append(v[:115], np.zeros(13, int))).tobytes() for v in rows]
    return [(int(i), bytearray(p), 100) for i, p in zip(ids, packed, strict=True)]


def test_partners_are_all_pairs_within_eleven_bits(spark):
    rows = prints_of(300, 13, True)
    df = spark.createDataFrame(rows, "id long, print binary, n int").repartition(3)
    bits = {i: int.from_bytes(bytes(p), "big") for i, p, _ in rows}
    near = {(a, b) for a in bits for b in bits if b < a and (bits[a] ^ bits[b]).bit_count() <= 11}
    for block, held in ((1 << 14, 1 << 21), (80, 300)):  # the second sends crowded keys on block by block
        found = simhash.partners(df, 1 << 30, block, held)
        got = {(r.x, r.y) for r in found.where("x is not null").collect()}
        assert near <= got and all(a > b for a, b in got) and not found.where("rows is not null").count()
        found = simhash.partners(df, 1, block, held)
        first = {(r.x, r.y) for r in found.where("x is not null").collect()}
        assert first < got
        # What first partners leave out is in reach of each other in some packed bucket.
        none = spark.createDataFrame([], "node long, component long")
        of = {r.node: r.component for r in simhash.reaches(found.where("rows is not null"), none).collect()}
        assert all(of.get(a, a) == of.get(b, b) for a, b in near - first)


def test_buckets_of_one_group_are_not_looked_at_again(spark, monkeypatch):
    rows = prints_of(300, 14, True)
    found = simhash.partners(spark.createDataFrame(rows, "id long, print binary, n int"), 1).where("rows is not null")
    one = spark.createDataFrame([(i, -400) for i, *_ in rows], "node long, component long")
    assert found.count() and simhash.reaches(found, one).count() == 0
    monkeypatch.setattr(simhash, "FEW", 0)
    assert simhash.reaches(found, one).count() > 0


def test_edited_copies_and_chains_leave_one(spark, monkeypatch):
    """Forty texts of which each has another one with a similarity of 0.8; a crowd beyond the limits of the first round."""
    random.seed(15)
    words = [f"w{random.randint(0, 10**6)}" for _ in range(400)]
    texts = []
    for _ in range(120):
        t = list(words)
        for at in random.sample(range(len(t)), 3):
            t[at] = f"x{random.randint(0, 10**6)}"
        texts.append(" ".join(t))
    texts += [" ".join(f"y{random.randint(0, 10**6)}" for _ in range(60)) for _ in range(20)]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for limit, block, tile in ((4, 1 << 14, 1024), (1, 70, 16)):
        monkeypatch.setattr(simhash, "TILE", tile)
        assert sorted(r.doc_id for r in simhash.distinct(df, limit=limit, block=block).collect()) == sorted(set(label))


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data here")
def test_distinct_against_all_pairs(spark):
    """The documents of a whole table: one of each group that all pairs with a similarity of 0.8 connect."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect())
    sets = [simhash.shingles(t) for _, t in rows]
    label = np.arange(len(rows))
    for i, u in enumerate(sets):
        for j in range(i):
            v = sets[j]
            if 0.8 * max(len(u), len(v)) <= min(len(u), len(v)):
                common = len(np.intersect1d(u, v, assume_unique=True)) if len(u) else 0
                if common >= 0.8 * (len(u) + len(v) - common):
                    a, b = label[i], label[j]
                    label[(label == a) | (label == b)] = min(a, b)
    want = sorted({rows[i][0] for i in label})
    assert len(want) < len(rows) and sorted(r.doc_id for r in simhash.distinct(docs.repartition(4)).collect()) == want
