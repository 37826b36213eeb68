"""Fuzzy repeated passages by collinear chaining of shared seeds.

Seeds are winnowed word k-grams, each with short hashes of what stands around it. An occurrence of a seed is linked to the seed's first one and the
one before, to the last one before with the same next seed, with the same previous seed, and, where the same ``LONG`` words follow, to the first and the last of those;
so the links are a few times the seeds at most, and the occurrences are the same however the rows are dealt to tasks. The links between a
document and an earlier one are chained: ordered in both texts, each seed for its words, gaps for a cost; a Fenwick tree over the earlier
text's places gives the best chain that ends before a seed. Chains are cut where they skip more than ``SKIP`` words. Chains are aligned word by word, extended at both ends, and parted where too
little matches. What is left with enough words and similarity is a passage that the document repeats.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import collecting, durable, few, forget_paths, lean, only, partitions, prepared, shielded

K = 5  # words of a seed
WINDOW = 5  # of consecutive k-grams, one at least is a seed
GAP = 0.05  # cost of a word that a chain skips in either text; a seed is worth K
LONG = 46  # 50 words of an exact copy hold a seed that starts at one of the first WINDOW words, and so many words from there on
SKIP = 512  # words of either text that a passage may skip at once
BLOCK = 64  # words of an earlier text that are fetched at once
MARGIN = 24  # words beyond a chain that an alignment may reach
NEAR = 8  # of the MARGIN words beyond a seed, those of which two bits go along; one of the others
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


_CHUNK = 1 << 20  # bytes of a text that are hashed at once
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


@lru_cache(maxsize=8)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64: sums of values times falling powers give hashes of any stretch."""
    base = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(1 << bits, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))


def _sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of values times falling powers up to each place, and the rising powers: ``(sums[z] - sums[a]) * up[a]`` is the hash of values a to z."""
    bits = max(12, len(values).bit_length())
    up, down = _powers(bits + bits % 2)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * down[: len(values)]))), up


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of the lower-case words of a text."""
    data, out, at = np.frombuffer(text.lower().encode(), np.uint8), [], 0
    while at < len(data):
        end = min(len(data), at + _CHUNK)
        if end < len(data):  # no word is parted
            blanks = np.flatnonzero(_BLANK[data[at:end]])
            more = np.flatnonzero(_BLANK[data[end:]])[:1] if not len(blanks) else ()
            end = at + int(blanks[-1]) + 1 if len(blanks) else end + int(more[0]) + 1 if len(more) else len(data)
        part = data[at:end]
        edges = np.diff(np.concatenate(([1], _BLANK[part].view(np.int8), [1])))
        a, z = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums, up = _sums(part.astype(np.uint64) + np.uint64(1))
        h = (sums[z] - sums[a]) * up[a]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(h ^ (h >> np.uint64(29)))
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def short(words: np.ndarray) -> np.ndarray:
    """32 bits of each word's hash: what alignments compare."""
    return (words ^ (words >> np.uint64(32))).astype(np.uint32)


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Winnowed k-grams of hashed words: their hashes and places."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        grams = words[:n].copy()
        for i in range(1, k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    grams ^= grams >> np.uint64(32)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    window = min(window, n)
    width = 1
    while 2 * width <= window:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    m = n - window + 1
    key = np.minimum(key[:m], key[window - width : window - width + m])
    at = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate(([True], at[1:] != at[:-1]))]
    return grams[at].view(np.int64), at


def numbered(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seeds, and once more those that occur again in their text, under a key that holds how often they came before.

    A text that repeats itself thereby meets another one that does turn by turn, not only at its first turn.
    """
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(key) else np.empty(0, bool)
    turn = np.empty(len(key), np.int64)
    turn[order] = np.arange(len(key)) - np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
    again = turn > 0
    with np.errstate(over="ignore"):
        other = (key[again] ^ (turn[again] * np.int64(-7046029254386353131))) * np.int64(-4658895280553007687)
    return np.concatenate((key, other)), np.concatenate((at, at[again]))


def around(words: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What stands around each seed, as short hashes; 0 where nothing does: the next seed and its distance, the previous one and its, the ``LONG`` words from there on."""
    mix = np.int64(-7046029254386353131)
    after, before, far = np.zeros(len(key), np.uint8), np.zeros(len(key), np.uint8), np.zeros(len(key), np.uint16)
    with np.errstate(over="ignore"):
        pair = ((key[:-1] * mix + key[1:]) * mix + np.diff(at)) * mix
        byte = (pair.view(np.uint64) % np.uint64(255) + np.uint64(1)).astype(np.uint8)
        after[:-1], before[1:] = byte, byte
        whole = at + LONG <= len(words)
        sums, up = _sums(words)
        long = (sums[at[whole] + LONG] - sums[at[whole]]) * up[at[whole]]
        long = (long ^ (long >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    far[whole] = ((long >> np.uint64(20)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)
    return after, before, far


def _strips(pairs: np.ndarray) -> np.ndarray:
    """For each place two bits of ``NEAR`` words from there on, and one of those up to ``MARGIN``, the first ones lowest; zeros follow the last one."""

    def strip(bits: np.ndarray, n: int, each: int) -> np.ndarray:
        width = 1
        while width < n:
            bits = bits[:-width] | bits[width:] << np.uint32(each * width)
            width *= 2
        return bits

    n, long = len(pairs), np.concatenate((pairs, np.zeros(MARGIN, np.uint32)))
    return strip(long, NEAR, 2)[:n] | strip(long & np.uint32(1), MARGIN - NEAR, 1)[NEAR : n + NEAR] << np.uint32(2 * NEAR)


def surroundings(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Some bits of :func:`_byte` of each of the ``MARGIN`` words before and after the seeds at ``at``, and of those after ``LONG`` words from there on."""
    pairs = np.concatenate((_byte(short(words)) & np.uint8(3), np.zeros(1, np.uint8))).astype(np.uint32)
    before, after = _strips(pairs[::-1])[::-1], _strips(pairs)
    return np.where(at > 0, before[at - 1], np.uint32(0)), after[np.minimum(at + K, len(words))], after[np.minimum(at + LONG, len(words))]


@lru_cache(maxsize=1)
def _walks() -> tuple[np.ndarray, np.ndarray]:
    """How :func:`_reach` goes on along words whose bits differ in given ones: words to the best score (0 if none is better), matches up to there, all matches, drop of
    the score below its best (5: the way has ended). For the ``NEAR`` first words, and for those up to ``MARGIN`` by the drop before them."""

    def walk(same: np.ndarray, drop: int) -> np.ndarray:
        n = same.shape[1]
        score, alive = np.full(n, -drop), np.full(n, drop < 5)
        best, far, matched, total = np.zeros((4, n), np.int64)
        for i, hit in enumerate(same):
            total, score = total + hit, score + np.where(hit, 1, -1)
            better = alive & (score > best)
            best, far, matched = np.where(better, score, best), np.where(better, i + 1, far), np.where(better, total, matched)
            alive &= score >= best - 4
        return np.stack([far, matched, total, np.where(alive, best - score, 5)], axis=1).astype(np.int16)

    first, rest = (np.arange(1 << n) for n in (2 * NEAR, MARGIN - NEAR))
    near = walk(np.stack([(first >> 2 * i & 3) == 0 for i in range(NEAR)]), 0)
    same = np.stack([(rest >> i & 1) == 0 for i in range(MARGIN - NEAR)])
    return near, np.stack([walk(same, drop) for drop in range(6)])


def outward(mine: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What :func:`reaches` gives for words of which a few bits are known (:func:`surroundings`): how far, plus 32 times the matches. It is never less than by bytes."""
    differ, (first, rest) = mine ^ other, _walks()
    near = first[differ & np.uint32((1 << 2 * NEAR) - 1)]
    on = rest[near[:, 3], differ >> np.uint32(2 * NEAR)]
    more = on[:, 0] > 0
    return np.where(more, NEAR + on[:, 0], near[:, 0]) + 32 * np.where(more, near[:, 2] + on[:, 1], near[:, 1])


def bounds(p0: np.ndarray, p1: np.ndarray, q0: np.ndarray, left: np.ndarray, right: np.ndarray, words: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains (first and last place, first earlier place, ways outward) the places between which their passages lie, and whether these may be long and like enough."""
    before, after = np.minimum(left % 32, np.minimum(p0, q0)), right % 32
    low, high = p0 - before, p1 + K + after
    matched = p1 + K - p0 + np.minimum(left // 32, before) + right // 32
    return low, high, (high - low >= words) & (matched >= words * similarity)


def chains(p: np.ndarray, q: np.ndarray, least: int = 2) -> list[tuple[float, list[int]]]:
    """Best collinear chains of links (place p, earlier place q), each link in one chain at most: (score, links in order).

    Score of a chain: K for each link (less where links overlap), minus GAP for each word skipped on either side. The gap cost is a sum of
    terms of the two ends, so the best predecessor of a link is a maximum over links with smaller p and q: a prefix query of a Fenwick tree.
    """
    n = len(p)
    order = np.lexsort((-q, p))  # links at one p don't follow each other
    dp, dq = np.diff(p[order]), np.diff(q[order])
    if (dp > 0).all() and (dq > 0).all() and (dp + dq <= 2 / GAP).all():  # each link is worth going on from the one before: one chain
        return [(float(K + np.minimum(K, np.minimum(dp, dq)).sum() - GAP * (dp + dq).sum()), order.tolist())] if n >= least else []
    order = order.tolist()
    ranks = np.unique(q, return_inverse=True)[1].tolist()
    size = max(ranks) + 1
    tree: list[int] = [-1] * (size + 1)
    best, value, before = [0.0] * n, [0.0] * n, [-1] * n
    ps, qs = p.tolist(), q.tolist()
    for i in order:
        r, top = ranks[i], -1
        while r > 0:
            j = tree[r]
            if j >= 0 and (top < 0 or value[j] > value[top]):
                top = j
            r -= r & -r
        gain = 0.0
        if top >= 0:
            new = min(K, ps[i] - ps[top], qs[i] - qs[top])
            gain = value[top] - GAP * (ps[i] + qs[i]) + new - K
        best[i] = K + max(0.0, gain)
        before[i] = top if gain > 0 else -1
        value[i] = best[i] + GAP * (ps[i] + qs[i])
        r = ranks[i] + 1
        while r <= size:
            if tree[r] < 0 or value[i] > value[tree[r]]:
                tree[r] = i
            r += r & -r
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -best[i]):
        links = []
        while i >= 0 and not used[i]:
            used[i] = True
            links.append(i)
            i = before[i]
        if len(links) >= least:
            out.append((best[links[0]] - (best[i] if i >= 0 else 0), links[::-1]))
    return out


def best_chains(d: np.ndarray, t: np.ndarray, p: np.ndarray, q: np.ndarray, far: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """Chains of links sorted by earlier text (d, t), p and q: (score, places of their links). Single links count if they are ``far`` ones.

    Where each of a text's links goes on from the one before at a small cost, they are one chain; that is seen for all texts at once. The others are chained.
    """
    n = len(p)
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
    start = np.flatnonzero(new)
    dp, dq = (np.diff(c.astype(np.int64), prepend=0) for c in (p, q))
    broken = ~new & ((dp <= 0) | (dq <= 0) | (dp + dq > 2 / GAP))
    gain = np.where(new, K, np.minimum(K, np.minimum(dp, dq)) - GAP * (dp + dq))
    plain, score, size = ~np.logical_or.reduceat(broken, start), np.add.reduceat(gain, start), np.diff(np.append(start, n))
    out = []
    some = ~plain | (size > 1) | far[start]
    for a, m, one, value in zip(start[some].tolist(), size[some].tolist(), plain[some].tolist(), score[some].tolist(), strict=True):
        if one:
            out.append((value, np.arange(a, a + m)))
            continue
        for value_, c in chains(p[a : a + m], q[a : a + m], 1):
            use = a + np.array(c)
            if len(c) == 1:
                if far[use[0]]:
                    out.append((value_, use))
            else:
                out += [(value_, use[part]) for part in unbroken(p[use], q[use])]
    return out


def covered(p: np.ndarray) -> np.ndarray:
    """Runs (from, to) of the places that a chain's links cover; links further apart than ``MARGIN`` words leave what is between them to others."""
    cuts = np.flatnonzero(np.diff(p) > MARGIN)
    return np.stack([p[np.concatenate(([0], cuts + 1))], p[np.concatenate((cuts, [len(p) - 1]))] + K], axis=1)


def adds(runs: np.ndarray, taken: np.ndarray, least: int) -> bool:
    """Whether at least half of a chain's runs, or ``least`` words in a row of one, are places that are not taken."""
    total = free = 0
    if not taken[runs[0, 0] : runs[-1, 1]].any():
        return True
    for a, z in runs.tolist():
        mine = ~taken[a:z]
        total, free = total + z - a, free + int(mine.sum())
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mine.view(np.int8), [0]))))
        if len(edges) and (edges[1::2] - edges[::2]).max() >= least:
            return True
    return 2 * free >= total


def _gap(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matching places between two word lists: equal places if they are as long, else a longest common subsequence, a row of its table at a time as bits."""
    if not len(a) or not len(b):
        return []
    if len(a) == len(b):
        return [(i, i) for i in np.flatnonzero(a == b).tolist()]
    where: dict[int, int] = {}
    for j, v in enumerate(b.tolist()):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, now = [], full
    for v in a.tolist():
        hit = now & where.get(v, 0)
        now = (now + hit | now - hit) & full
        rows.append(now)
    i, j, out = len(a), len(b), []
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:  # nothing is gained at this place of b
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def unbroken(p: list[int], q: list[int]) -> list[slice]:
    """The parts of a chain that skip at most ``SKIP`` words at once in either text."""
    if max(p[-1] - p[0], q[-1] - q[0]) <= SKIP + K:
        return [slice(0, len(p))]
    gaps = np.flatnonzero(np.maximum(np.diff(p), np.diff(q)) > SKIP + K) + 1
    edges = [0, *gaps.tolist(), len(p)]
    return [slice(a, z) for a, z in zip(edges, edges[1:], strict=False)]


def _reach(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places that match along the diagonal from a chain's end outwards, as far as the score (1 a match, -1 else) is best; it may drop by 4."""
    score, best, out, kept = 0, 0, [], 0
    for i, same in enumerate((a[: min(len(a), len(b))] == b[: min(len(a), len(b))]).tolist()):
        score += 1 if same else -1
        if same:
            out.append(i)
        if score > best:
            best, kept = score, len(out)
        if score < best - 4:
            break
    return out[:kept]


def aligned(a: np.ndarray, b: np.ndarray, links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Matching words (place in a, place in b) of a chain of links between two word lists, in order."""
    pairs: list[tuple[int, int]] = []
    i = 0
    while i < len(links):
        # Links on one diagonal, and what lies between them, are compared in one go.
        (x, y), j = links[i], i + 1
        while j < len(links) and links[j][1] - links[j][0] == y - x:
            j += 1
        end, i = links[j - 1][0] + K, j
        if pairs:
            x0, y0 = pairs[-1][0] + 1, pairs[-1][1] + 1
            if x < x0 or y < y0:
                skip = max(x0 - x, y0 - y)
                x, y = x + skip, y + skip
            else:
                pairs += [(x0 + u, y0 + v) for u, v in _gap(a[x0:x], b[y0:y])]
        n = min(end - x, len(a) - x, len(b) - y)
        if n > 0:
            hit = np.flatnonzero(a[x : x + n] == b[y : y + n])
            pairs += zip((x + hit).tolist(), (y + hit).tolist(), strict=True)
    if not pairs:
        return []
    x, y = pairs[0]
    left = [(x - 1 - i, y - 1 - i) for i in _reach(a[:x][::-1], b[:y][::-1])][::-1]
    x, y = pairs[-1]
    return left + pairs + [(x + 1 + i, y + 1 + i) for i in _reach(a[x + 1 :], b[y + 1 :])]


def parts(pairs: list[tuple[int, int]], words: int, similarity: float) -> list[list[tuple[int, int]]]:
    """Stretches of an alignment of at least ``words`` words whose share of matching words is at least ``similarity``; parted at the widest gap."""
    out, todo = [], [pairs]
    while todo:
        now = todo.pop()
        if len(now) < words * similarity:
            continue
        span = max(now[-1][0] - now[0][0], now[-1][1] - now[0][1]) + 1
        if len(now) >= similarity * span:
            if now[-1][0] - now[0][0] + 1 >= words:
                out.append(now)
            continue
        gaps = np.diff(np.array(now), axis=0).max(axis=1)
        at = int(gaps.argmax()) + 1
        todo += [now[:at], now[at:]]
    return out


_SEED = np.dtype([("key", "<i8"), ("doc", "<i8"), ("turn", "<i4"), ("at", "<i4"), ("after", "u1"), ("before", "u1"), ("far", "<u2"), ("left", "<u4"), ("right", "<u4"), ("beyond", "<u4")])
_LINK = "doc long, turn int, at int, to_doc long, to_turn int, to_at int, reach int"


def _folded(r: np.ndarray) -> bytes:
    """Rows as planes of bytes, which compress better than rows."""
    return r.view(np.uint8).reshape(len(r), _SEED.itemsize).T.tobytes()


def _unfolded(b) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(_SEED.itemsize, -1).T).view(_SEED).ravel()


def _runs(group: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows by group and text: those with an earlier text of their group, the group's first row, and the last row of the text before theirs."""
    at = np.arange(len(group))
    new = np.concatenate(([True], group[1:] != group[:-1]))
    lead = np.maximum.accumulate(np.where(new, at, 0))
    start = np.maximum.accumulate(np.where(new | np.concatenate(([True], text[1:] != text[:-1])), at, 0))
    rows = np.flatnonzero(start > lead)
    return rows, lead[rows], start[rows] - 1


def _link(x: np.ndarray, y: np.ndarray, to_at: np.ndarray) -> np.ndarray:
    """Links of seeds x to y, as rows of ``_LINK``; reach tells how far they may go on, see :func:`outward`: before them, 1024 times after them, and 2**20 times
    after the same ``LONG`` words where such follow (to_at < 0)."""
    reach = outward(x["left"], y["left"]) + (outward(x["right"], y["right"]).astype(np.int64) << 10)
    far = np.flatnonzero(to_at < 0)
    reach[far] += outward(x["beyond"][far], y["beyond"][far]).astype(np.int64) << 20
    return np.stack([x["doc"], x["turn"], x["at"], y["doc"], y["turn"], to_at, reach], axis=1)


def linked(r: np.ndarray) -> np.ndarray:
    """Links of the rows of whole seeds, as rows (doc, turn, at, to_doc, to_turn, to_at, reach); to_at is -1 - to_at where the same ``LONG`` words follow."""
    if not len(r):
        return np.empty((0, 7), np.int64)
    r = r[np.lexsort((r["at"], r["turn"], r["doc"], r["key"]))]
    key = np.cumsum(np.concatenate(([False], r["key"][1:] != r["key"][:-1])))
    text = np.cumsum(np.concatenate(([False], (r["doc"][1:] != r["doc"][:-1]) | (r["turn"][1:] != r["turn"][:-1]) | (key[1:] != key[:-1]))))
    several = (np.bincount(key[_runs(key, text)[0]], minlength=key[-1] + 1) > 0)[key]  # seeds of one text only need no more
    r, key, text = r[several], key[several], text[several]
    if not len(r):
        return np.empty((0, 7), np.int64)
    rows, lead, last = _runs(key, text)
    pairs = [(rows, lead), (rows, last)]
    for c in ("after", "before", "far"):
        some = np.flatnonzero(r[c])
        some = some[np.lexsort((r[c][some], key[some]))]
        if not len(some):
            continue
        rows, lead, last = (some[x] for x in _runs(key[some] * 65536 + r[c][some], text[some]))
        pairs += [(rows, last)] if c != "far" else [(rows, last), (rows, lead)]
    x, y = np.divmod(np.unique(np.concatenate([x * len(r) + y for x, y in pairs])), len(r))
    far = (r["far"][x] == r["far"][y]) & (r["far"][x] > 0)
    to_at = np.where(far, -1 - r["at"][y].astype(np.int64), r["at"][y])
    return _link(r[x], r[y], to_at)


def links(docs: DataFrame, block: int = 1 << 17, held: int = 1 << 19) -> DataFrame:
    """Links (doc, turn, at, to_doc, to_turn, to_at) of each seed's occurrences to earlier documents', see :func:`linked`; also of seeds that repeat in their text,
    turn by turn."""
    return reaching(docs, block, held).drop("reach")


def reaching(docs: DataFrame, block: int = 1 << 17, held: int = 1 << 19) -> DataFrame:
    """:func:`links`, and reach: how far a passage may go on beyond the seed.

    ``docs`` has doc, turn and text. Each task of the first step sends what belongs to one stretch of seeds as one packed row; a task of the second holds a
    stretch, about ``held`` rows at most: rows of a seed with more than ``block`` are passed on and dealt anew, those with the same words after them together, in
    groups of about ``block`` that are linked in themselves and to the seed's first occurrence.
    """
    tasks = partitions(docs.sparkSession)
    stretches = 16 * tasks

    def emit(batches):
        for b in bpe.small(batches, 1024):
            ids, turns = (np.array(b.column(c).to_numpy(zero_copy_only=False)) for c in ("doc", "turn"))
            made, flat, places, size, apart = [], [], [], 0, np.zeros(MARGIN, np.uint64)
            for doc, turn, x in zip(ids, turns, bpe.texts_of(b.column("text")), strict=True):
                h = hashes(x)
                key, at = seeds(h)
                if not len(key):
                    continue
                more, at_all = numbered(key, at)
                r = np.zeros(len(more), _SEED)
                r["key"], r["doc"], r["turn"], r["at"] = more, doc, turn, at_all
                r["after"][: len(key)], r["before"][: len(key)], r["far"][: len(key)] = around(h, key, at)
                made.append(r)
                places.append(size + at_all)
                flat += [h, apart]
                size += len(h) + MARGIN
            if not made:
                continue
            r = np.concatenate(made)
            r["left"], r["right"], beyond = surroundings(np.concatenate(flat), np.concatenate(places))
            r["beyond"] = np.where(r["far"] > 0, beyond, 0)
            stretch = (r["key"].astype(np.uint64) >> np.uint64(32)) * np.uint64(stretches) >> np.uint64(32)
            order = np.lexsort((r["key"], stretch))
            r, stretch = r[order], stretch[order].astype(np.int32)
            first = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
            yield pa.RecordBatch.from_arrays([pa.array(stretch[first]), pa.array([_folded(x) for x in np.split(r, first[1:])], pa.binary())], names=["stretch", "packed"])

    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
    names = ["doc", "turn", "at", "to_doc", "to_turn", "to_at", "reach"]

    def columns(made: np.ndarray) -> list[pa.Array]:
        return [pa.array(made[:, i].astype(k.to_pandas_dtype()), k) for i, k in enumerate(kinds)]

    def batch(made, big=None):
        n = len(made) if big is None else len(big)
        if big is None:
            cols = columns(made)
        else:  # what follows, in to_doc
            cols = [pa.array(big[c].astype(k.to_pandas_dtype()), k) for c, k in zip(("doc", "turn", "at", "far"), kinds, strict=False)] + [pa.nulls(n, k) for k in kinds[4:]]
        more = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())] if big is None else [pa.array(np.array(big["key"])), pa.array([v.tobytes() for v in big], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, *more], names=[*names, "key", "row"])

    def scan(batches):
        at, parts, n, room, large = None, [], 0, held, np.empty(0, np.int64)

        def crowds(r, large):
            keys, counts = np.unique(r["key"], return_counts=True)
            large = np.union1d(large, keys[counts > block])
            known = np.isin(r["key"], large)
            return r[known], r[~known], large

        def finished():
            big, rest, _ = crowds(np.concatenate(parts), large)
            if len(big):
                yield batch(None, big)
            yield batch(linked(rest))

        for b in batches:
            for stretch, packed in zip(b.column("stretch").to_pylist(), b.column("packed"), strict=True):
                if stretch != at:
                    if n:
                        yield from finished()
                    at, parts, n, room, large = stretch, [], 0, held, np.empty(0, np.int64)
                parts.append(_unfolded(packed.as_buffer()))
                n += len(parts[-1])
                if n > room:
                    big, rest, large = crowds(np.concatenate(parts), large)
                    if len(big):
                        yield batch(None, big)
                    parts, n = [rest], len(rest)
                    room = max(held, 2 * n)
        if parts:
            yield from finished()

    sent = docs.mapInArrow(emit, "stretch int, packed binary").repartition(tasks, "stretch").sortWithinPartitions("stretch")
    found = durable(sent.mapInArrow(scan, f"{_LINK}, key long, row binary"))
    plain = found.where("key IS NULL").select(*names)
    big = found.where("key IS NOT NULL").select("key", "row", "doc", "turn", "at", F.col("to_doc").alias("far"))
    if not big.limit(1).count():
        return plain
    groups = lambda n: F.ceil(n / F.lit(block)).cast("long")
    per_far = big.groupBy(F.col("key").alias("_k"), F.col("far").alias("_f")).agg(F.count("*").alias("_n"))
    per_key = big.groupBy(F.col("key").alias("_key")).agg(groups(F.count("*")).alias("_groups"), F.min(F.struct("doc", "turn", "at", "row")).alias("_first"))
    # Sizes go to the rows as long as they are few; the rows of a crowded seed don't meet in one task.
    dealt = few(few(big, durable(per_far), (F.col("key") == F.col("_k")) & (F.col("far") == F.col("_f"))), durable(per_key), F.col("key") == F.col("_key"))
    home = F.pmod(F.when(F.col("far") == 0, F.xxhash64("doc")).otherwise(F.xxhash64("far")), F.col("_groups"))
    part = F.pmod(F.xxhash64("doc", F.lit(1)), groups(F.col("_n")))
    dealt = dealt.select("key", "row", "doc", "turn", "at", "_first", home.alias("home"), F.when(F.col("far") == 0, F.lit(0).cast("long")).otherwise(part).alias("part"))

    def of_packed(rows) -> np.ndarray:
        return np.frombuffer(b"".join(rows.to_pylist()), _SEED)

    def together(table: pa.Table) -> pa.Table:
        return pa.table(columns(linked(of_packed(table.column("row")))), names=names)

    def to_first(batches):
        for b in batches:
            x, y = of_packed(b.column("row")), of_packed(b.column("to"))
            yield pa.RecordBatch.from_arrays(columns(_link(x, y, y["at"])), names=names)

    mine = dealt.select("key", "home", "part", "row").groupBy("key", "home", "part").applyInArrow(together, _LINK)
    first = dealt.where((F.col("doc") != F.col("_first.doc")) | (F.col("turn") != F.col("_first.turn")))
    first = first.select("row", F.col("_first.row").alias("to")).mapInArrow(to_first, _LINK)
    return plain.unionByName(mine).unionByName(first)


def proven(p: np.ndarray, q: np.ndarray, words: int) -> list[tuple[int, int]]:
    """Stretches (from, to) of at least ``words`` places whose words a chain's links show to be the same: they lie in a passage, however the chain is aligned and parted."""
    dp, dq = np.diff(p), np.diff(q)
    edges = np.concatenate(([0], np.flatnonzero((dp != dq) | (dp > K)) + 1, [len(p)]))
    a, z = p[edges[:-1]] + np.where(edges[:-1] > 0, K, 0), p[edges[1:] - 1] + K  # an alignment may skip words where the diagonal changes
    return [(x, y) for x, y in zip(a.tolist(), z.tolist(), strict=True) if y - x >= words]


def _alone(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` gives, written; the tables that were written on the way are deleted."""
    mine: list[str] = []
    token = collecting.set(mine)
    try:
        out = make()
    finally:
        collecting.reset(token)
    out = durable(out)
    forget_paths(out.sparkSession, mine)
    return out


def chosen(docs: DataFrame, words: int, similarity: float = 0.8) -> DataFrame:
    """Chains (doc, turn, chain, to_doc, to_turn, p, q, spare) of documents (doc, turn, text). Spare are those whose places better chains have taken, and single links;
    whether they hold a passage that lies in no other one is seen once the others are aligned. Only those are left out that hold no passage, as a few bits of each word around
    them show (see :func:`bounds`), or only one in the midst of words that are surely repeated.
    """
    least_single = words - K - MARGIN  # words that must stand before a link that is alone

    def chained(batches):
        """Chains of each document, best first."""
        for b in batches:
            ids: list[np.ndarray] = []
            sizes: list[np.ndarray] = []
            ps: list[np.ndarray] = []
            qs: list[np.ndarray] = []

            def add(doc, turn, first, d, t, size, p, q, low, high, spare):
                n = len(d)
                ids.append(np.stack([np.full(n, doc), np.full(n, turn), np.arange(first, first + n), d, t, low, high, np.full(n, spare)]).astype(np.int64))  # noqa: B023
                sizes.append(size)  # noqa: B023
                ps.append(p)  # noqa: B023
                qs.append(q)  # noqa: B023

            for doc, turn, found in zip(b.column("doc").to_pylist(), b.column("turn").to_pylist(), b.column("links"), strict=True):
                values = found.values
                d, t, p, q, reach = (np.array(values.field(c).to_numpy(zero_copy_only=False)) for c in ("to_doc", "to_turn", "at", "to_at", "reach"))
                far, q = q < 0, np.where(q < 0, -1 - q, q)
                order = np.lexsort((~far, q, p, t, d))
                d, t, p, q, far, reach = (c[order] for c in (d, t, p, q, far, reach))
                new = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])))  # several seeds may give one link
                d, t, p, q, far, reach = (c[new] for c in (d, t, p, q, far, reach))
                left, right, beyond = reach & 1023, reach >> 10 & 1023, reach >> 20
                taken, n, sure, alone = np.zeros(int(p.max()) + K + LONG, bool), 0, [], np.ones(len(p), bool)
                inside = lambda low, high: np.any([(low >= a) & (high <= z) for a, z in sure], axis=0) if sure else np.zeros(len(low), bool)  # noqa: B023, E731
                if made := best_chains(d, t, p, q, far):
                    uses = [use for _, use in made]
                    all_, size = np.concatenate(uses), np.array([len(use) for use in uses])
                    end = np.cumsum(size)
                    i, j = all_[end - size], all_[end - 1]  # first and last links
                    # Where the same words follow a seed, the last of them is as good as a link, if it lies beyond the others.
                    last = np.maximum.reduceat(np.where(far[all_], np.arange(len(all_)), -1), end - size)
                    on = all_[last]
                    on_p, on_q = p[on] + LONG - K, q[on] + LONG - K
                    longer = (last >= 0) & (on_p > p[j]) & (on_q > q[j])
                    p1, q1 = np.where(longer, on_p, p[j]), np.where(longer, on_q, q[j])
                    low, high, may = bounds(p[i], p1, q[i], left[i], np.where(longer, beyond[on], right[j]), words, similarity)
                    whole = size + longer > 1
                    alone[all_[np.repeat(whole, size)]] = False
                    # At least the words between the guaranteed seeds of a passage that is long enough.
                    least = words - 2 * MARGIN
                    rank = np.lexsort((q[i], p[i], t[i], d[i], -np.array([score for score, _ in made])))
                    kept: list[int] = []
                    held: list[int] = []

                    def places(x):
                        use = uses[x]  # noqa: B023
                        if longer[x]:  # noqa: B023
                            return np.append(p[use], p1[x]), np.append(q[use], q1[x])  # noqa: B023
                        return p[use], q[use]  # noqa: B023

                    def put(some, spare):
                        made_ = [places(x) for x in some]  # noqa: B023
                        pp, qq = (np.concatenate(c) for c in zip(*made_, strict=True))
                        add(doc, turn, n, d[i[some]], t[i[some]], [len(x) for x, _ in made_], pp, qq, low[some], high[some], spare)  # noqa: B023

                    for x in rank[(whole & (p1 + K - p[i] >= least))[rank]].tolist():
                        a, z = p[i[x]], p1[x] + K
                        if taken[a:z].all() or not adds(runs := covered(places(x)[0]), taken, least):
                            if may[x]:
                                held.append(x)
                            continue
                        kept.append(x)
                        sure += proven(p[uses[x]], q[uses[x]], words)
                        for a, z in runs.tolist():
                            taken[a:z] = True
                    if kept:
                        put(kept, 0)
                        n = len(kept)
                    if held:
                        held = [x for x, o in zip(held, inside(low[held], high[held]).tolist(), strict=True) if not o]
                    if held:
                        put(held, 1)
                        n += len(held)
                one = np.flatnonzero(alone & (np.minimum(p, q) >= least_single))
                low, high, may = bounds(p[one], p[one], q[one], left[one], right[one], words, similarity)
                may &= ~inside(low, high)
                if may.any():
                    one, low, high = one[may], low[may], high[may]
                    add(doc, turn, n, d[one], t[one], np.ones(len(one), np.int64), p[one], q[one], low, high, 1)
            if not ids:
                continue
            doc, turn, chain, td, tt, low, high, spare = np.concatenate(ids, axis=1)
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(c).astype(np.int32), pa.int32())) for c in (ps, qs)]
            narrow = [pa.array(c.astype(np.int32), pa.int32()) for c in (turn, chain, tt, low, high)]
            cols = [pa.array(doc, pa.int64()), narrow[0], narrow[1], pa.array(td, pa.int64()), narrow[2], *lists, *narrow[3:], pa.array(spare.astype(bool))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "turn", "chain", "to_doc", "to_turn", "p", "q", "low", "high", "spare"])

    def by_doc() -> DataFrame:
        found = reaching(docs)
        docs.sparkSession._jvm.System.gc()
        lean(docs.sparkSession)  # the seeds' shuffle files go before the links are shuffled
        return found.groupBy("doc", "turn").agg(F.collect_list(F.struct("to_doc", "to_turn", "at", "to_at", "reach")).alias("links"))

    return _alone(lambda: by_doc().mapInArrow(chained, "doc long, turn int, chain int, to_doc long, to_turn int, p array<int>, q array<int>, low int, high int, spare boolean"))


def _asked(docs: DataFrame, need: DataFrame) -> DataFrame:
    """The documents that ``need`` (to_doc, to_turn, wants) asks for words, with what it wants."""
    need = durable(need)
    sought = need.select(F.col("to_doc").alias("_sd"), F.col("to_turn").alias("_st"))
    wanted = few(docs, sought, (F.col("doc") == F.col("_sd")) & (F.col("turn") == F.col("_st")), "left_semi")
    return wanted.join(need, (F.col("doc") == F.col("to_doc")) & (F.col("turn") == F.col("to_turn"))).select("doc", "turn", "text", "wants")


def candidates(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (_d, _t, chains, blocks): the chains ``found`` of each document, and the words around their places in the earlier documents."""
    low = F.greatest(F.element_at("q", 1) - MARGIN, F.lit(0))
    high = F.element_at("q", -1) + K + MARGIN
    blocks = F.sequence(F.floor(low / BLOCK).cast("int"), F.floor(high / BLOCK).cast("int"))
    wanted = found.select("doc", "turn", "chain", "to_doc", "to_turn", F.explode(blocks).alias("block"))
    need = wanted.select("to_doc", "to_turn", "block").distinct().groupBy("to_doc", "to_turn").agg(F.collect_list("block").alias("wants"))

    def fetched(batches):
        for b in bpe.small(batches):
            out = []
            for doc, turn, x, wants in zip(b.column("doc").to_pylist(), b.column("turn").to_pylist(), bpe.texts_of(b.column("text")), b.column("wants").to_pylist(), strict=True):
                h = short(hashes(x))
                out += [(doc, turn, w, h[w * BLOCK : (w + 1) * BLOCK].tobytes()) for w in wants if w * BLOCK < len(h)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64(), pa.int32(), pa.int32(), pa.binary()], strict=True)], names=["b_doc", "b_turn", "b_block", "words"])

    fetched_ = _asked(docs, need).mapInArrow(fetched, "b_doc long, b_turn int, b_block int, words binary")
    same = (F.col("to_doc") == F.col("b_doc")) & (F.col("to_turn") == F.col("b_turn")) & (F.col("block") == F.col("b_block"))
    near = wanted.join(fetched_, same).groupBy("doc", "turn").agg(F.collect_list(F.struct("chain", "block", "words")).alias("blocks"))
    all_ = found.groupBy(F.col("doc").alias("_d"), F.col("turn").alias("_t")).agg(F.collect_list(F.struct("chain", "to_doc", "to_turn", "p", "q")).alias("chains"))
    return durable(all_.join(near, (F.col("_d") == F.col("doc")) & (F.col("_t") == F.col("turn"))).select("_d", "_t", "chains", "blocks"))


def _byte(words: np.ndarray) -> np.ndarray:
    """A byte of each word's short hash; 0 stands for no word."""
    return (words % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def reaches(own: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of bytes from a chain's end outwards: how far :func:`_reach` goes at most, and how many words match up to there. More matches never shorten its way."""
    same = (own == seen) & (seen > 0)
    score = np.cumsum(np.where(same, 1, -1), axis=1, dtype=np.int16)
    dead = np.maximum.accumulate(score < np.maximum.accumulate(np.maximum(score, 0), axis=1) - 4, axis=1)
    score[dead] = -1
    far, at = score.argmax(axis=1) + 1, np.arange(len(own))
    far[score[at, far - 1] <= 0] = 0
    matched = np.concatenate((np.zeros((len(own), 1), np.int64), np.cumsum(same, axis=1)), axis=1)
    return far, matched[at, far]


def outside(low: np.ndarray, high: np.ndarray, kept: list[dict]) -> np.ndarray:
    """Which stretches lie in none of the passages that are ``kept``; these are in order, and none lies in another one."""
    if not kept:
        return np.ones(len(low), bool)
    start, end = (np.array([k[c] for k in kept]) for c in ("start", "end"))
    at = np.searchsorted(start, low, "right") - 1  # of those that begin so early, the last one ends last
    return (at < 0) | (high > end[at])


def _with(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have candidates, with them, and the others. Only the former are shuffled, if they are few."""
    keys = found.select(F.col("_d").alias("_kd"), F.col("_t").alias("_kt"))
    same = (F.col("_doc") == F.col("_kd")) & (F.col("_turn") == F.col("_kt"))
    return few(rows, keys, same, "left_semi").join(found, _same()), few(rows, keys, same, "left_anti")


def _same():
    """Rows of :func:`quillvec.llm.common.prepared` and their candidates."""
    return (F.col("_doc") == F.col("_d")) & (F.col("_turn") == F.col("_t"))


def _found(mine: np.ndarray, chains: list | None, blocks: list | None, words: int, similarity: float, known: list | None = None) -> list[dict]:
    """Passages of a text's words from its chains, aligned with the words that were fetched for them, and those ``known``; in order."""
    out = list(known or [])
    fetched: dict[int, list] = {}
    for k in blocks or []:
        fetched.setdefault(k["chain"], []).append((k["block"], k["words"]))
    for c in chains or []:
        got = sorted(fetched[c["chain"]])
        low = got[0][0] * BLOCK
        other = np.frombuffer(b"".join(w for _, w in got), np.uint32)
        shift = max(0, c["p"][0] - MARGIN)
        a = mine[shift : c["p"][-1] + K + MARGIN]
        pairs = aligned(a, other, [(u - shift, v - low) for u, v in zip(c["p"], c["q"], strict=True)])
        for part in parts(pairs, words, similarity):
            out.append({
                "start": part[0][0] + shift, "end": part[-1][0] + shift + 1, "source": c["to_doc"], "source_turn": c["to_turn"],
                "source_start": part[0][1] + low, "source_end": part[-1][1] + low + 1, "matched": len(part),
            })
    kept, end = [], 0
    for o in sorted(out, key=lambda o: (o["start"], -o["end"], o["source"], o["source_start"])):
        if o["end"] > end:  # not inside another passage
            kept.append(o)
            end = o["end"]
    return kept


_FIELDS = [("start", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_turn", pa.int32()), ("source_start", pa.int32()), ("source_end", pa.int32()), ("matched", pa.int32())]
_PASSAGES = "array<struct<start:int,end:int,source:long,source_turn:int,source_start:int,source_end:int,matched:int>>"


def passages(rows: DataFrame, text: str, words: int, similarity: float) -> DataFrame:
    """Rows (_d, _t, found): the passages of each document that has chains. ``rows`` has _doc and _turn, from :func:`quillvec.llm.common.prepared`.

    Spare chains come second: of those, the ones are aligned that may reach beyond all passages of the others.
    """
    docs = rows.select(F.col("_doc").alias("doc"), F.col("_turn").alias("turn"), F.col(text).alias("text"))
    found = chosen(docs, words, similarity)
    spare = found.where("spare")

    def first() -> DataFrame:
        keys = durable(found.select(F.col("doc").alias("_kd"), F.col("turn").alias("_kt")).distinct())
        mine = few(rows.select("_doc", "_turn", F.col(text).alias("text")), keys, (F.col("_doc") == F.col("_kd")) & (F.col("_turn") == F.col("_kt")), "left_semi")
        both = mine.join(candidates(docs, found.where("NOT spare")), _same(), "left")
        spares = spare.groupBy(F.col("doc").alias("_sd"), F.col("turn").alias("_st")).agg(F.collect_list(F.struct("chain", "low", "high")).alias("spares"))
        both = both.join(spares, (F.col("_doc") == F.col("_sd")) & (F.col("_turn") == F.col("_st")), "left")
        return both.select(F.col("_doc").alias("_d"), F.col("_turn").alias("_t"), "text", "chains", "blocks", "spares").mapInArrow(compared, f"_d long, _t int, found {_PASSAGES}, more array<int>")

    def compared(batches):
        for b in bpe.small(batches):
            lists, more = [], []
            for x, c, k, s in zip(bpe.texts_of(b.column("text")), b.column("chains").to_pylist(), b.column("blocks").to_pylist(), b.column("spares"), strict=True):
                mine = short(hashes(x))
                lists.append(_found(mine, c, k, words, similarity))
                todo = np.empty(0, np.int32)
                if s.is_valid:
                    chain, low, high = (np.array(s.values.field(f)) for f in ("chain", "low", "high"))
                    todo = chain[outside(low, np.minimum(high, len(mine)), lists[-1])]
                more.append(todo.tolist())
            yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_t"), pa.array(lists, pa.list_(pa.struct(_FIELDS))), pa.array(more, pa.list_(pa.int32()))], names=["_d", "_t", "found", "more"])

    made = _alone(first)
    todo = made.select(F.col("_d").alias("_cd"), F.col("_t").alias("_ct"), F.explode("more").alias("_c"))
    if not todo.limit(1).count():
        return made.select("_d", "_t", "found")
    again = durable(few(spare, todo, (F.col("doc") == F.col("_cd")) & (F.col("turn") == F.col("_ct")) & (F.col("chain") == F.col("_c")), "left_semi"))
    known = made.where(F.size("more") > 0).select(F.col("_d").alias("_kd"), F.col("_t").alias("_kt"), F.col("found").alias("known"))
    second = candidates(docs, again).join(known, (F.col("_d") == F.col("_kd")) & (F.col("_t") == F.col("_kt"))).select("_d", "_t", "chains", "blocks", "known")
    second = _with(rows, durable(second))[0].select("_d", "_t", F.col(text).alias("text"), "chains", "blocks", "known")

    def aligned_(batches):
        for b in bpe.small(batches):
            columns = (bpe.texts_of(b.column("text")), *(b.column(c).to_pylist() for c in ("chains", "blocks", "known")))
            lists = [_found(short(hashes(x)), c, k, words, similarity, o) for x, c, k, o in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_t"), pa.array(lists, pa.list_(pa.struct(_FIELDS)))], names=["_d", "_t", "found"])

    return made.where(F.size("more") == 0).select("_d", "_t", "found").unionByName(second.mapInArrow(aligned_, f"_d long, _t int, found {_PASSAGES}"))


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 50, similarity: float = 0.8) -> DataFrame:
    """One row per repeated passage: ``key``, start and end (words of its text), source (the ``key`` of an earlier document), source_start, source_end,
    matched (words), similarity.

    A passage has at least ``words`` words and at least ``similarity`` of them match, in order, those of the source. Words are runs without ASCII white
    space, compared in lower case. Texts that are null, empty or shorter take no part. Earlier is a smaller key; rows of one key come by
    text, null keys first. Repeats inside one text are not passages, nor is what lies inside another passage of the text. The result does not depend on how the rows are dealt to tasks.
    """
    rows = prepared(only(df, key, text), key, text)
    p = passages(rows, text, words, similarity).select(F.col("_d").alias("doc"), F.explode("found").alias("p"))
    back = lambda c: F.when(F.col(c) != F.lit(-(1 << 63)), F.col(c))
    out = p.select(back("doc").alias(key), "p.start", "p.end", back("p.source").alias("source"), "p.source_start", "p.source_end", "p.matched")
    return out.withColumn("similarity", F.col("matched") / F.greatest(F.col("end") - F.col("start"), F.col("source_end") - F.col("source_start")))


def cut(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 50, similarity: float = 0.8) -> DataFrame:
    """``df`` whose ``text`` lacks the passages that :func:`repeats` finds, and _cut: the number of words that went. Other texts stay as they are."""
    df, names, to = shielded(df)
    key, text = to[key], to[text]
    rows = prepared(df, key, text)
    found = durable(passages(rows, text, words, similarity).where(F.size("found") > 0).select("_d", "_t", F.transform("found", lambda x: F.struct(x["start"], x["end"])).alias("spans")))
    both, others = (x.select(*df.columns, *more) for x, more in zip(_with(rows, found), (["spans"], []), strict=True))
    at = df.columns.index(text)

    def run(batches):
        for b in bpe.small(batches):
            texts, gone = [], []
            for x, spans in zip(b.column(f"k_{at}").to_pylist(), b.column("spans").to_pylist(), strict=True):
                out, n = x, 0
                if spans:
                    places = [m.span() for m in _WORD.finditer(x)]
                    drop = np.zeros(len(places) + 1, bool)
                    for s in spans:
                        drop[s["start"] : s["end"]] = True
                    keep, done = [], 0
                    for i, (a, _) in enumerate([*places, (len(x), len(x))]):
                        if i < len(places) and drop[i] or i and drop[i - 1]:
                            keep.append("" if i and drop[i - 1] else x[done:a])
                            done = a
                    out, n = "".join(keep) + x[done:], int(drop.sum())
                texts.append(out)
                gone.append(n)
            cols = [pa.array(texts, pa.string()) if i == at else b.column(f"k_{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(gone, pa.int32())], names=[*(f"k_{i}" for i in range(len(names))), "_cut"])

    schema = ", ".join([*(f"k_{i} {df.schema[f'k_{i}'].dataType.simpleString()}" for i in range(len(names))), "_cut int"])
    return both.mapInArrow(run, schema).unionByName(others.withColumn("_cut", F.lit(0))).select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(names)], "_cut")
