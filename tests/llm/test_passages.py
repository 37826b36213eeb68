import random

import numpy as np
import pytest

from quillvec.llm import passages


def words(n, seed):
    rng = random.Random(seed)
    return ["w%d" % rng.randint(0, 100_000) for _ in range(n)]


def best_chain(p, q):
    """The best chain's score, by comparing all pairs."""
    order = sorted(range(len(p)), key=lambda i: (p[i], q[i]))
    best = {}
    for i in order:
        best[i] = passages.K
        for j in order:
            if j in best and p[j] < p[i] and q[j] < q[i]:
                new = min(passages.K, p[i] - p[j], q[i] - q[j])
                best[i] = max(best[i], best[j] + new - passages.GAP * (p[i] - p[j] + q[i] - q[j]))
    return max(best.values())


def test_chains_are_collinear_and_near_the_best():
    random.seed(1)
    for _ in range(150):
        n = random.randint(1, 25)
        p = np.array([random.randint(0, 80) for _ in range(n)])
        q = np.array([random.randint(0, 80) for _ in range(n)])
        found = passages.chains(p, q, 1)
        used = [i for _, c in found for i in c]
        assert len(used) == len(set(used))
        for score, c in found:
            assert all(p[a] < p[b] and q[a] < q[b] for a, b in zip(c, c[1:], strict=False))
        # The predecessor is chosen by a prefix maximum before overlaps are taken off, so the score is near the best, never above it.
        top, want = max(s for s, _ in found), best_chain(p.tolist(), q.tolist())
        assert top <= want + 1e-9 and top >= 0.5 * want
    spaced = np.arange(0, 400, 10)
    assert len(passages.chains(spaced, spaced + 7)[0][1]) == 40


def test_winnowing_keeps_one_of_each_window():
    h = passages.hashes(" ".join(words(500, 2)))
    key, at = passages.seeds(h)
    assert (np.diff(at) <= passages.WINDOW).all() and at[0] < passages.WINDOW
    assert len(passages.seeds(h[:4])[0]) == 0 and len(passages.seeds(h[:5])[0]) == 1


def test_alignment():
    a = passages.hashes("a b c d e f g h i j k l m n o p")
    b = passages.hashes("x a b c d e f q g h i j k l m o p")
    pairs = passages.aligned(a, b, [(0, 1), (9, 11)])
    assert pairs == [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 8), (7, 9), (8, 10), (9, 11), (10, 12), (11, 13), (12, 14)] or pairs[:13] == [(i, i + 1) for i in range(6)] + [(i, i + 2) for i in range(6, 13)]
    long = [(i, i) for i in range(60)] + [(i, i) for i in range(160, 230)]
    assert [(p[0][0], p[-1][0]) for p in passages.parts(long, 50, 0.8)] == [(160, 229), (0, 59)]


def docs():
    passage, other = words(120, 5), words(300, 6)
    fuzzy = [w if i % 17 else "changed" for i, w in enumerate(passage)]
    rows = [(i, " ".join(words(200, 100 + i))) for i in range(20)]
    rows += [
        (30, " ".join(words(80, 31) + passage + words(60, 32))),
        (31, " ".join(words(20, 33) + passage + words(90, 34))),
        (32, " ".join(words(50, 35) + fuzzy[:60] + ["new", "words"] + fuzzy[60:] + words(10, 36))),
        (33, " ".join(words(50, 37) + passage[:30] + words(50, 38))),  # too short
        (34, " ".join(other)), (35, " ".join(other).upper()), (36, " ".join(other)), (36, " ".join(other)), (37, None), (38, ""), (None, " ".join(words(70, 39))),
    ]
    return rows


def test_repeats(spark):
    df = spark.createDataFrame([(*r, 1) for r in docs()], "doc_id long, text string, _doc int").repartition(4)
    got = sorted((r.doc_id, r.source, r.start, r.end) for r in passages.repeats(df).collect())
    ends = {(d, s): (a, z) for d, s, a, z in got}
    assert ends[31, 30] == (20, 140)
    a, z = ends.get((32, 30)) or ends[32, 31]
    assert abs(a - 50) <= 1 and abs(z - 172) <= 1
    assert ends[35, 34] == ends[36, 34 if (36, 34) in ends else 35] == (0, 300)
    assert {d for d, *_ in got} == {31, 32, 35, 36}
    assert sum(d == 36 for d, *_ in got) == 2  # both rows of the key, one of which repeats the other or the source
    similar = [r.similarity for r in passages.repeats(df).collect()]
    assert all(0.8 <= s <= 1 for s in similar)


def test_cut(spark):
    df = spark.createDataFrame([(*r, "x") for r in docs()], "doc_id long, text string, _spans string")
    got = passages.cut(df)
    assert got.columns == ["doc_id", "text", "_spans", "_cut"]
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append((r.text, r._cut))
    before = {}
    for d, t in docs():
        before.setdefault(d, []).append(t)
    assert by[31] == [(" ".join(words(20, 33) + words(90, 34)), 120)]
    assert by[35] == [("", 300)] and sorted(by[36]) == [("", 300), ("", 300)]
    assert all(by[d] == [(t, 0) for t in before[d]] for d in before if d not in (31, 32, 35, 36))


def test_seed_that_all_share(spark):
    """One passage in every document: links are as many as its seeds, and all but the first document lose it."""
    passage = words(60, 1)
    rows = [(i, " ".join(words(40, 50 + i) + passage + words(40, 500 + i))) for i in range(120)]
    got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    assert {r.doc_id for r in got} == set(range(1, 120)) and all((r.start, r.end) == (40, 100) for r in got)


def test_texts_that_repeat_themselves(spark):
    """The same word over and over, and a list of a few lines again and again: no seed is unique."""
    lines = [" ".join(words(12, s)) for s in range(4)]
    rows = [(1, " ".join(words(30, 1) + ["from"] * 200)), (2, " ".join(["from"] * 150 + words(30, 2))), (3, " ".join(lines * 10)), (4, " ".join(words(20, 3) + (lines * 8)[:-1]))]
    got: dict = {}
    for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    assert set(got) == {2, 4} and len(got[2]) >= 140 and len(got[4]) >= 0.95 * 12 * 31


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string").limit(0)
    assert passages.repeats(df).collect() == [] and passages.cut(df).collect() == []


@pytest.mark.parametrize("text", ["a  b\tc\n\nd e", "É ß\xa0x y"])
def test_words_are_those_of_the_text(text):
    assert len(passages.hashes(text)) == len(passages._WORD.findall(text))


def test_passages_between_and_around_others(spark):
    """A header and a footer of one document round a passage of another one: all three are found, whichever chain is the better."""
    head, foot, middle, long = words(60, 71), words(60, 72), words(60, 73), words(400, 74)
    rows = [
        (1, " ".join(head + words(300, 75) + foot)), (2, " ".join(words(30, 76) + middle + words(30, 77))), (3, " ".join(words(10, 78) + long + words(10, 79))),
        (10, " ".join(head + words(40, 80) + middle + words(40, 81) + foot)), (11, " ".join(head + long + foot)),
    ]
    got = {(r.doc_id, r.start, r.end) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert {(10, 0, 60), (10, 100, 160), (10, 200, 260), (11, 0, 60), (11, 60, 460), (11, 460, 520)} <= got


def test_phrases_that_first_stood_elsewhere(spark):
    """Every phrase of a copied passage stood in an earlier document of its own, and again between source and copy."""
    passage = words(60, 90)
    strays = [words(9, 900 + i) + passage[i : i + 9] + words(9, 1900 + i) for i in range(0, 52, 4)]
    rows = [(i, " ".join(x)) for i, x in enumerate(strays)] + [(100 + i, " ".join(x[::-1][:9] + x[9:18])) for i, x in enumerate(strays)]
    rows += [(50, " ".join(words(30, 91) + passage + words(30, 92))), (200, " ".join(words(40, 93) + passage + words(20, 94)))]
    for parts in (1, 5):
        got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert [(r.doc_id, r.source, r.start, r.end) for r in got] == [(200, 50, 40, 100)]


def test_edited_passages(spark):
    """Copies of 60 words with ten of the inner ones changed: few runs of five words are left."""
    rng, rows = random.Random(7), []
    for i in range(60):
        passage = words(60, 3000 + i)
        edited = list(passage)
        for at in rng.sample(range(2, 58), 10):
            edited[at] = "new%d" % rng.randint(0, 10**6)
        rows += [(i, " ".join(words(40, 4000 + i) + passage)), (1000 + i, " ".join(words(50, 5000 + i) + edited + words(50, 6000 + i)))]
    got = {r.doc_id - 1000 for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.source == r.doc_id - 1000}
    assert len(got) >= 54


def test_halves_elsewhere(spark):
    """A passage that stands whole in two documents, its halves in two earlier ones, and once more between the two."""
    passage = words(80, 200)
    halves = [(1, passage[:40]), (2, passage[40:]), (4, passage[:40]), (5, passage[40:])]
    rows = [(i, " ".join(words(20, 210 + i) + h + words(20, 220 + i))) for i, h in halves]
    rows += [(3, " ".join(words(20, 213) + passage + words(20, 223))), (9, " ".join(words(10, 219) + passage + words(30, 229)))]
    for parts in (1, 4):
        got = passages.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
        assert [(r.doc_id, r.source, r.start, r.end) for r in got] == [(9, 3, 10, 90)]


def brute(rows, least=50):
    """Words of each text that lie in runs of at least so many words which an earlier text has."""
    out, seen = {}, set()
    for d, text in sorted(rows):
        w = text.split()
        grams = [tuple(w[i : i + least]) for i in range(len(w) - least + 1)]
        out[d] = {j for i, g in enumerate(grams) if g in seen for j in range(i, i + least)}
        seen |= set(grams)
    return out


def test_exact_repeats_against_brute_force(spark):
    """Documents patched together from a small stock of passages and frequent phrases, in blocks of seeds or not: nearly all repeated words are found, others are not."""
    rng = random.Random(17)
    stock = [words(rng.randint(50, 90), 300 + i) for i in range(12)]
    phrases = [words(rng.randint(6, 45), 400 + i) for i in range(8)] + [s[a : a + 30] for s in stock[:6] for a in (0, 25)]
    rows = []
    for d in range(150):
        text = []
        for _ in range(rng.randint(2, 6)):
            text += rng.choice(stock) if rng.random() < 0.4 else rng.choice(phrases)
            text += words(rng.randint(5, 40), 1000 + 10 * d + len(text))
        rows.append((d, " ".join(text)))
    want = brute(rows)
    assert sum(map(len, want.values())) > 5000
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got: dict = {}
    for r in passages.repeats(df).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        assert r.similarity >= 0.8 and r.end - r.start >= 50
    missed = sum(len(v - got.get(d, set())) for d, v in want.items())
    assert missed <= 0.001 * sum(map(len, want.values()))


def test_links_do_not_depend_on_partitions_and_survive_crowds(spark):
    rng = random.Random(18)
    shared = words(60, 500)
    rows = [(d, 0, " ".join(words(20, 600 + d) + (shared if d % 2 else shared[: rng.randint(10, 50)]) + words(20, 900 + d))) for d in range(80)]
    df = spark.createDataFrame(rows, "doc long, turn int, text string")
    once = {tuple(r) for r in passages.links(df.repartition(2)).collect()}
    assert once and once == {tuple(r) for r in passages.links(df.repartition(7)).collect()}
    dealt = {tuple(r) for r in passages.links(df.repartition(3), block=8, held=50).collect()}
    assert dealt and all(r[3] < r[0] for r in dealt)
    # Whole texts are still linked to others that have the same words on.
    of = {(d, t) for d, _, _, t, _, _ in dealt}
    assert all(any((d, t) in of for t in range(1, d, 2)) for d in range(3, 80, 2))


def test_gaps_are_longest_common_subsequences():
    rng = np.random.default_rng(19)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(0, 12)), rng.integers(0, 4, rng.integers(0, 12))
        if len(a) == len(b):
            continue
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        got = passages._gap(a, b)
        assert len(got) == table[-1, -1] and all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    rng = random.Random(21)
    text = "".join(rng.choice("ab É\t\n x\x0b日") for _ in range(3000)) + " " + "long" * 500 + " end"
    want: dict = {}
    parts = text.lower().encode().split()
    for h, w in zip(passages.hashes(text).tolist(), parts, strict=True):
        assert want.setdefault(w, h) == h
    assert len(set(want.values())) == len(want)
    monkeypatch.setattr(passages, "_CHUNK", 7)
    assert passages.hashes(text).tolist() == [want[w] for w in parts]


def test_chains_that_are_no_passage_take_no_place(spark):
    """A long but loose likeness (12 of each 20 words) of one document stands round an exact passage of another; and a passage reaches a few words beyond a better one."""
    text, passage = words(300, 1001), words(70, 1005)
    loose = [w if i % 20 < 12 else "x%d" % i for i, w in enumerate(text)]
    rows = [(1, " ".join(loose)), (2, " ".join(words(30, 1002) + text[120:180] + words(30, 1003))), (9, " ".join(text))]
    for i in range(1, 8):
        d = 100 * i
        rows += [(d, " ".join(passage_ := [w + "abcdefg"[i - 1] for w in passage[:60]])), (d + 1, " ".join(w + "abcdefg"[i - 1] for w in passage[i : 60 + i]))]
        rows.append((d + 2, " ".join(words(10, 1010 + i) + passage_ + [w + "abcdefg"[i - 1] for w in passage[60:]] + words(10, 1020 + i))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.start, r.end) for r in passages.repeats(df.repartition(3)).collect()}
    assert {x for x in got if x[0] == 9} == {(9, 120, 180)}
    for i in range(1, 8):
        assert {x for x in got if x[0] == 100 * i + 2} == {(100 * i + 2, 10, 70), (100 * i + 2, 10 + i, 70 + i)}
    gone = {r.doc_id: r._cut for r in passages.cut(df).collect()}
    assert gone[9] == 60 and all(gone[100 * i + 2] == 60 + i for i in range(1, 8))


def test_passages_with_one_seed(spark):
    """Words are changed six apart, but nine in a row stay, which hold a seed or a few, often one only."""
    rows = []
    for i in range(20):
        passage = words(61, 1100 + i)
        edited = ["new%d" % j if j in (0, 6, 12, 18, 24, 34, 40, 46, 52, 58) else w for j, w in enumerate(passage)]
        rows += [(i, " ".join(words(40, 1200 + i) + passage + words(40, 1300 + i))), (1000 + i, " ".join(words(40, 1400 + i) + edited + words(40, 1500 + i)))]
    got = {(r.doc_id - 1000, r.source) for r in passages.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, i) for i in range(20)}


def test_bytes_reach_at_least_as_far_as_words():
    rng = np.random.default_rng(23)
    for _ in range(300):
        a = rng.integers(0, 600, passages.MARGIN).astype(np.uint32)
        b = np.where(rng.random(passages.MARGIN) < 0.7, a, rng.integers(0, 600, passages.MARGIN)).astype(np.uint32)
        hit = passages._reach(a, b)
        far, matched = passages.reaches(passages._byte(a)[None], passages._byte(b)[None])
        assert not hit or far[0] > hit[-1] and matched[0] >= len(hit)


def test_few_bits_reach_at_least_as_far_as_bytes():
    rng, n, k = np.random.default_rng(24), passages.MARGIN, passages.K
    seed = rng.integers(0, 1 << 60, passages.LONG, np.uint64)
    for _ in range(200):
        a = rng.integers(0, 1 << 60, (2, n), np.uint64)
        b = np.where(rng.random((2, n)) < rng.choice([0.5, 0.8, 1]), a, rng.integers(0, 1 << 60, (2, n), np.uint64))
        for m in (k, passages.LONG):
            both = [passages.surroundings(np.concatenate((x[0][::-1], seed[:m], x[1])), np.array([n])) for x in (a, b)]
            ways = [passages.outward(x, y)[0] for x, y in zip(*both, strict=True)]
            for side, way in ((0, ways[0]), (1, ways[1 if m == k else 2])):
                far, matched = passages.reaches(*(passages._byte(passages.short(x[side]))[None] for x in (a, b)))
                assert way % 32 >= far[0] and way // 32 >= matched[0]


def test_links_that_can_hold_no_passage_are_not_kept(spark):
    """Phrases of nine words in texts that have nothing else in common: their links are no chains to be looked at, but those inside a longer likeness are."""
    phrase, passage = words(9, 1600), words(60, 1601)
    rows = [(i, 0, " ".join(words(40, 1700 + i) + phrase + words(40, 1800 + i))) for i in range(40)]
    rows += [(100 + i, 0, " ".join(words(30, 1900 + i) + passage + words(30, 2000 + i))) for i in range(2)]
    got = passages.chosen(spark.createDataFrame(rows, "doc long, turn int, text string"), 50).collect()
    assert {r.doc for r in got if r.spare} <= {101} and {(r.doc, r.to_doc) for r in got if r.doc >= 100} == {(101, 100)}
