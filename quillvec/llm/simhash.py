"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The binary Golay code (23, 12, 7) is perfect: each 23-bit
word has one codeword within distance 3, and the word with at most one other bit changed is within distance 4 of it. A
segment's fuzzy keys are the indices of all codewords within distance 4 (one or six). Two fingerprints that differ in
at most 3 bits have two segments with at most one error each, by pigeonhole; so the decoded index of either one is among the
other's keys there. For each pair of segments, the decoded pair of indices ("near") meets every pair of keys ("far").

:func:`distinct` has five whole segments, over the distinct words of a text, and all keys of both sides meet: that bridges two errors in
a segment, so texts with a five-word similarity of 0.8 meet under some pair of segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import FEW, components, durable, few, forget, only, partitions, prepared, shielded

BITS = 64
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit and width; short ones are padded with zero bits
PAIRS = ((0, 1), (0, 2), (1, 2))
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the Golay code.
GENERATOR = 0b101011100011


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the three bytes of a word; for each syndrome the error patterns of weight up to 4; how many those are."""

    def remainder(w: int) -> int:
        for i in range(22, 10, -1):
            if w >> i & 1:
                w ^= GENERATOR << (i - 11)
        return w

    one = [remainder(1 << i) for i in range(23)]
    bytes_ = np.zeros((3, 256), np.int32)
    for k in range(3):
        for b in range(256):
            for i in range(8):
                if b >> i & 1 and 8 * k + i < 23:
                    bytes_[k, b] ^= one[8 * k + i]
    patterns, n = np.zeros((2048, 6), np.int32), np.zeros(2048, np.int32)
    for weight in range(5):
        for at in combinations(range(23), weight):
            s = 0
            for i in at:
                s ^= one[i]
            if weight < 4 or n[s] and patterns[s, 0].item().bit_count() == 3:
                patterns[s, n[s]] = sum(1 << i for i in at)
                n[s] += 1
    return bytes_, patterns, n


def fuzzy(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within distance 4 of each 23-bit word, the decoded one first, and their number."""
    bytes_, patterns, n = golay()
    s = bytes_[0][words & 255] ^ bytes_[1][words >> 8 & 255] ^ bytes_[2][words >> 16]
    return (words[:, None] ^ patterns[s]) >> 11, n[s]


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of one text: XXH64 (seed 42) of its word shingles, repeats included; 0 without a word."""
    parts = text.encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        digests = xxhash.xxh64_digest(joined, 42)
    else:
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate(([0], ends[:-words]))
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[a:b], 42) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist(), strict=True)])
    n = len(digests) // 8
    ones = np.zeros(BITS, np.int64)
    raw = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and ``fingerprint`` (the 64 bits as a signed long) of each whole text; null texts count as empty."""

    def run(batches):
        for b in bpe.small(batches):
            prints = np.array([fingerprint(x, words) for x in bpe.texts_of(b.column(text))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(prints, pa.int64())], names=[key, "fingerprint"])

    return only(df, key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fingerprint long")


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket keys of fingerprints: key, position of the fingerprint, whether it is the near one."""
    u = prints.view(np.uint64)
    parts = [fuzzy(((u >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int32)) for a, w in SEGMENTS]
    out: list[tuple] = []
    for p, (i, j) in enumerate(PAIRS):
        (ci, ni), (cj, nj) = parts[i], parts[j]
        for a in range(6):
            for b in range(6):
                at = np.flatnonzero((a < ni) & (b < nj))
                out.append(((p << 24) + (ci[at, a].astype(np.int64) << 12) + cj[at, b], at, np.full(len(at), a == b == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def settle(n: int, x: np.ndarray, y: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest position in the component of each of ``n`` positions, from links x-y and earlier labels."""
    labels = np.arange(n) if labels is None else labels
    while len(x):
        low = np.minimum(labels[x], labels[y])
        before = labels.copy()
        for side in (labels[x], labels[y]):  # the roots move, and with them all that point there
            np.minimum.at(labels, side, low)
        labels = labels[labels]
        while (labels != labels[labels]).any():
            labels = labels[labels]
        if (labels == before).all() and (labels[x] == labels[y]).all():
            break
    return labels


def within(prints: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is linked in one bucket: a star for each component, not all pairs."""
    u = prints.view(np.uint64)
    a = np.flatnonzero(near)
    labels = np.arange(len(u))
    for at in range(0, len(a), max(1, (1 << 21) // len(u))):
        rows = a[at : at + max(1, (1 << 21) // len(u))]
        x, y = np.nonzero(np.bitwise_count(u[rows, None] ^ u[None, :]) <= most)
        labels = settle(len(u), rows[x], y, labels)
    other = np.flatnonzero(labels != np.arange(len(u)))
    return prints[other], prints[labels[other]]


def linked(key: np.ndarray, prints: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of rows sorted by key."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(first, len(key)))
    nears = np.add.reduceat(near.astype(np.int64), first)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for g in np.flatnonzero((nears > 0) & (nears * size > 4096)):
        s = slice(first[g], first[g] + size[g])
        out.append(within(prints[s], near[s], most))
    ok = (size > 1) & (nears > 0) & (nears * size <= 4096)
    group = np.repeat(np.arange(len(first)), size)
    rows = np.flatnonzero(near & ok[group])
    for part in np.array_split(rows, 1 + int(size[group[rows]].sum()) // (1 << 21)):
        n = size[group[part]]
        x = np.repeat(part, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + first[group[x]]
        hit = (np.bitwise_count(prints[x].view(np.uint64) ^ prints[y].view(np.uint64)) <= most) & (prints[x] != prints[y])
        out.append((prints[x[hit]], prints[y[hit]]))
    a, b = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (prints[:0], prints[:0])
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def links(prints: DataFrame, most: int = 3, block: int = 1 << 14) -> DataFrame:
    """Links (a, b) that connect the distinct ``fingerprint`` values of ``prints`` which differ in at most ``most`` (up to 3) bits.

    Every pair within that distance ends up connected; a crowded bucket gives a star for each of its components. Buckets are
    read in order of their key, with at most ``block`` rows in memory. A larger one is passed on and compared block by block,
    each pair of blocks in a task of its own.
    """
    if not 0 <= most <= 3:
        raise ValueError("the keys find up to 3 bits")

    def emit(batches):
        for b in batches:
            p = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(p), 4096):
                k, i, near = keys(np.ascontiguousarray(p[at : at + 4096]))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(p[at : at + 4096][i]), pa.array(near)], names=["key", "fingerprint", "near"])

    kind = "key long, fingerprint long, near boolean"

    def rows_of(b, names):
        return [np.array(b.column(c).to_numpy(zero_copy_only=False)) for c in names]

    def scan(batches):
        """Links of the buckets up to ``block`` rows; the rows of larger ones with ``big`` set."""
        held: list[list[np.ndarray]] = []
        big = None

        def out(a, b, flag, near=None):
            n = len(a)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.zeros(n, bool) if near is None else near), pa.array(np.full(n, flag))], names=["a", "b", "near", "big"])

        for batch in batches:
            key, p, near = rows_of(batch, ("key", "fingerprint", "near"))
            if not len(key):
                continue
            if big is not None:
                n = int(np.searchsorted(key, big, side="right"))
                if n:
                    yield out(key[:n], p[:n], True, near[:n])
                if n == len(key):
                    continue
                key, p, near, big = key[n:], p[n:], near[n:], None
            if held:
                key, p, near = (np.concatenate(z) for z in zip(*held, (key, p, near), strict=True))
                held = []
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield out(*linked(key[:last], p[:last], near[:last], most), False)
            if len(key) - last > block:
                big = key[-1]
                yield out(key[last:], p[last:], True, near[last:])
            else:
                held = [[key[last:], p[last:], near[last:]]]
        if held:
            yield out(*linked(*held[0], most), False)

    rows = prints.select("fingerprint").mapInArrow(emit, kind)
    found = durable(rows.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "a long, b long, near boolean, big boolean"))
    plain = found.where(~F.col("big")).select("a", "b")
    big = found.where("big").select(F.col("a").alias("key"), F.col("b").alias("fingerprint"), "near")
    # Near rows of a crowded bucket meet far rows in squares of blocks; each row is sent once for each block of the other side.
    sizes = big.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("fingerprint", F.lit(1)), F.col("n")).cast("int")
    square = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    near = big.where("near").join(sizes, "key").select("key", "fingerprint", mine.alias("i"), square.alias("j")).withColumn("near", F.lit(True))
    far = big.join(sizes, "key").select("key", "fingerprint", mine.alias("j"), square.alias("i")).select("key", "fingerprint", "i", "j", F.lit(False).alias("near"))

    def compare(table: pa.Table) -> pa.Table:
        p, is_near = rows_of(table, ("fingerprint", "near"))
        a, b = within(p, is_near, most)
        return pa.table({"a": a, "b": b})

    crowded = near.unionByName(far).groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")
    if not big.limit(1).count():
        return plain
    return plain.unionByName(crowded)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, most: int = 3) -> DataFrame:
    """One row per row of ``df``: ``key``, fingerprint (16 hex digits) and component_id, the smallest key reachable over links.

    Two rows are linked if their fingerprints differ in at most ``most`` bits; a text without a word (null, empty) has
    fingerprint 0 and is linked like any other. Rows of one fingerprint are reduced to a class before anything is compared.
    An empty ``df`` gives an empty result; rows may repeat.
    """
    made = durable(fingerprints(df, key, text, words))
    classes = durable(made.groupBy("fingerprint").agg(F.min(key).alias("_first")))
    roots = components(links(classes, most))
    led = classes.join(roots, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "_first", F.coalesce("component", "fingerprint").alias("_root"))
    heads = led.groupBy("_root").agg(F.min("_first").alias("component_id"))
    of = durable(led.join(heads, "_root").select(F.col("fingerprint").alias("_of"), "component_id"))
    return made.join(of, F.col("fingerprint") == F.col("_of")).select(
        key, F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the lower-cased word shingles of a text (fewer words: one of the whole sequence; none: none)."""
    parts = text.encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, 42) for s in joined]), np.dtype(">u8")).astype(np.uint64))


#: The wide fingerprint has five whole segments of 23 bits.
WIDE = 5
WIDE_PAIRS = tuple(combinations(range(WIDE), 2))
FAR = 12  # of the 64 bits that come along with a key, so many may differ
CROWD = 64  # rows up to which a bucket's pairs are all looked at
#: Sizes of sets, in sixteenths of a doubling: two sets with a similarity of 0.8 are within 6 of them.
STEPS, APART = 16, 6
SKETCH = 128  # counts of a sketch
_ROW = np.dtype([("key", "<u4"), ("id", "<i8"), ("rest", "<u8"), ("size", "u1")])
#: A row of a bucket that is looked at again: whether it asks (1) and is told of (2).
_LATER = np.dtype([*_ROW.descr, ("side", "u1")])
TILE = 1024  # rows of a group that meet in one task, on either side


class _Digests(dict):
    """128-bit hashes of words; emptied when full."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(word, 42)
        if len(word) <= 40:
            if len(self) > 100_000:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _digests() -> _Digests:
    return _Digests()


def wide_print(text: str) -> bytes:
    """SimHash of 115 bits (16 bytes, the last bits unused) over the distinct lower-case words of a text; zeros without a word."""
    words = set(text.encode().lower().split())
    raw = np.frombuffer(b"".join(map(_digests().__getitem__, words)), np.uint8).reshape(len(words), 16)
    ones = np.zeros(128, np.int64)
    for at in range(0, len(words), 1 << 14):
        ones += np.unpackbits(raw[at : at + (1 << 14)], axis=1).sum(axis=0, dtype=np.int64)
    ones[23 * WIDE :] = 0
    return np.packbits(2 * ones > len(words)).tobytes()


def wide_keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of wide fingerprints (rows of 16 bytes), pair of segments by pair: key, position of the fingerprint, 64 bits of its other segments.

    Two words of 23 bits that differ in at most two have a codeword within distance 4 of both. So two fingerprints meet if two of their
    segments differ in at most two bits each: always if they differ in at most 11, mostly if they differ in some more.
    """
    bits = np.unpackbits(prints, axis=1)[:, : 23 * WIDE].reshape(len(prints), WIDE, 23)
    parts = bits.astype(np.int32) @ (1 << np.arange(23, dtype=np.int32))
    lists = [fuzzy(parts[:, s]) for s in range(WIDE)]
    six = np.arange(6)
    for p, (i, j) in enumerate(WIDE_PAIRS):
        a, b, c = (parts[:, s].astype(np.uint64) for s in range(WIDE) if s not in (i, j))
        rest = a | b << np.uint64(23) | c << np.uint64(46)
        (ci, ni), (cj, nj) = lists[i], lists[j]
        at, x, y = np.nonzero((six < ni[:, None])[:, :, None] & (six < nj[:, None])[:, None, :])
        yield ((p << 24) + (ci[at, x].astype(np.uint32) << 12) + cj[at, y]).astype(np.uint32), at, rest[at]


def _small(rows: np.ndarray, first: np.ndarray, size: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """In buckets of few rows, which come by key and id: places of rows and of their first ``limit`` partners with smaller ids, and whether a pair is the last of more."""
    start = np.repeat(first, size)
    asks = np.flatnonzero((np.repeat(size, size) <= CROWD) & (np.arange(len(rows)) > start))
    pairs = np.cumsum(asks - start[asks]) >> 20
    for part in np.split(asks, np.flatnonzero(pairs[1:] != pairs[:-1]) + 1):
        n = part - start[part]
        x = np.repeat(part, n)
        y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + start[x]
        near = np.bitwise_count(rows["rest"][x] ^ rows["rest"][y]) <= FAR
        x, y = x[near], y[near]
        near = np.abs(rows["size"][x].astype(np.int16) - rows["size"][y]) <= APART
        x, y = x[near], y[near]
        if len(x):
            turn = np.arange(len(x)) - np.maximum.accumulate(np.where(np.concatenate(([True], x[1:] != x[:-1])), np.arange(len(x)), 0))
            more = (turn == limit - 1) & np.concatenate((x[1:] == x[:-1], [False]))
            use = turn < limit
            yield x[use], y[use], more[use]


def crowded(ask: np.ndarray, tell: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Places of rows of ``ask`` and of their first ``limit`` partners in ``tell``: within reach, with a smaller id; and whether any row has more. Both come by id."""
    out, more = [], False
    for at in range(0, len(ask), 256):
        block = ask[at : at + 256]
        found, open_ = np.zeros(len(block), np.int64), np.arange(len(block))
        for to in range(0, len(tell), 2048):
            a, t = block[open_], tell[to : to + 2048]
            if not len(a) or t["id"][0] >= a["id"].max():
                break
            hit = _near(a, t) & (t["id"][None] < a["id"][:, None])
            turn = found[open_][:, None] + np.cumsum(hit, axis=1)
            x, y = np.nonzero(hit & (turn <= limit))
            out.append((at + open_[x], to + y))
            found[open_] = turn[:, -1]
            open_ = open_[found[open_] <= limit]
        more = more or bool((found > limit).any())
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), more
    x, y = (np.concatenate(z) for z in zip(*out, strict=True))
    return x, y, more


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two lists are within reach of each other."""
    return (np.bitwise_count(a["rest"][:, None] ^ b["rest"][None]) <= FAR) & (np.abs(a["size"][:, None].astype(np.int16) - b["size"][None]) <= APART)


def _batch(x: np.ndarray, y: np.ndarray, buckets: list[np.ndarray] = (), key: np.ndarray | None = None) -> pa.RecordBatch:
    """Pairs, and packed buckets under a key: 0, or that of a bucket too large for one task, which comes row by row."""
    n, m = len(x), len(buckets)
    keys_ = pa.array(np.zeros(m, np.int64) if key is None else key)
    cols = [pa.concat_arrays([pa.array(v, pa.int64()), pa.nulls(m, pa.int64())]) for v in (x, y)]
    cols += [pa.concat_arrays([pa.nulls(n, pa.int64()), keys_]), pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([b.tobytes() for b in buckets], pa.binary())])]
    return pa.RecordBatch.from_arrays(cols, names=["x", "y", "key", "rows"])


_FOUND = "x long, y long, key long, rows binary"


def _first(r: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """First pairs (ids) of one bucket, and the bucket if some of its rows have more."""
    ask, tell = r[r["side"] & 1 > 0], r[r["side"] & 2 > 0]
    x, y, more = crowded(ask, tell, limit)
    return ask["id"][x], tell["id"][y], [r] if more else []


def partners(rows: DataFrame, limit: int = 1, block: int = 1 << 14, held: int = 1 << 21) -> DataFrame:
    """Pairs (x, y) of ids of rows whose wide fingerprints meet under a key and are within reach, y the smaller; and packed buckets (key, rows).

    ``rows`` has id (no two alike), print and n (the size of the set). A row gets its ``limit`` first partners of each bucket; buckets in which a row has more come
    along, for :func:`reaches`.

    Each task of the first step sends what belongs to one stretch of keys as one packed row. A task of the second holds a stretch, about ``held`` rows of it at
    most: rows of a key with more than ``block`` are passed on and compared block by block, each pair of blocks as a bucket in a task of its own.
    """
    tasks = partitions(rows.sparkSession)
    stretches = 16 * tasks

    def emit(batches):
        for b in bpe.small(batches, 2048):
            ids, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            prints = np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint8).reshape(-1, 16)
            if not len(ids):
                continue
            sizes = np.round(np.log2(np.maximum(n, 1)) * STEPS).clip(0, 255).astype(np.uint8)
            made = []
            for key, at, rest in wide_keys(prints):
                r = np.empty(len(key), _ROW)
                r["key"], r["id"], r["rest"], r["size"] = key, ids[at], rest, sizes[at]
                made.append(r)
            r = np.concatenate(made)
            stretch = ((r["key"] * np.uint32(2654435761)).astype(np.uint64) * np.uint64(stretches) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(stretch, kind="stable")
            r, stretch = r[order], stretch[order]
            first = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1])))
            ends = (np.append(first, len(r)) * _ROW.itemsize).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(r.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(stretch[first]), packed], names=["stretch", "packed"])

    def later(r):
        made = np.empty(len(r), _LATER)
        for c in _ROW.names:
            made[c] = r[c]
        made["side"] = 3
        return made

    none = np.empty(0, np.int64)

    def large(r):
        return _batch(none, none, [v for v in later(r)], r["key"].astype(np.int64) + 1)

    def looked(r):
        """Partners in a whole stretch."""
        r = r[np.lexsort((r["id"], r["key"]))]
        first = np.flatnonzero(np.concatenate(([True], r["key"][1:] != r["key"][:-1])))
        size = np.diff(np.append(first, len(r)))
        again = []
        for x, y, more in _small(r, first, size, limit):
            yield _batch(r["id"][x], r["id"][y])
            again.append(x[more])
        again = np.unique(np.searchsorted(first, np.concatenate(again), side="right") - 1) if again else none
        if len(again):
            yield _batch(none, none, [later(r[first[g] : first[g] + size[g]]) for g in again.tolist()])
        for g in np.flatnonzero(size > CROWD).tolist():
            s = r[first[g] : first[g] + size[g]]
            yield large(s) if len(s) > block else _batch(*_first(later(s), limit))

    def scan(batches):
        at, parts, n, room, known = None, [], 0, held, np.empty(0, np.uint32)
        for b in batches:
            for stretch, packed in zip(b.column("stretch").to_pylist(), b.column("packed"), strict=True):
                if stretch != at:
                    if n:
                        yield from looked(np.concatenate(parts))
                    at, parts, n, room, known = stretch, [], 0, held, np.empty(0, np.uint32)
                r = np.frombuffer(packed.as_buffer(), _ROW)
                if len(known):
                    yield large(r[np.isin(r["key"], known)])
                    r = r[~np.isin(r["key"], known)]
                parts.append(r)
                n += len(r)
                if n > room:
                    r = np.concatenate(parts)
                    keys_, counts = np.unique(r["key"], return_counts=True)
                    known = np.union1d(known, keys_[counts > block])
                    yield large(r[np.isin(r["key"], known)])
                    parts = [r[~np.isin(r["key"], known)]]
                    n = len(parts[0])
                    room = max(held, 2 * n)
        if n:
            yield from looked(np.concatenate(parts))

    sent = rows.select("id", "print", "n").mapInArrow(emit, "stretch int, packed binary").repartition(tasks, "stretch").sortWithinPartitions("stretch")
    found = durable(sent.mapInArrow(scan, _FOUND))
    big = found.where("key > 0").select("key", "rows")
    if not big.limit(1).count():
        return found
    sizes = big.groupBy("key").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n"))
    mine = F.pmod(F.xxhash64("rows"), F.col("n")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    both = big.join(sizes, "key")
    asking = both.select("key", mine.alias("i"), other.alias("j"), "rows", F.lit(1).alias("side"))
    telling = both.select("key", other.alias("i"), mine.alias("j"), "rows", F.lit(2).alias("side"))

    def compare(table: pa.Table) -> pa.Table:
        r = np.frombuffer(b"".join(table.column("rows").to_pylist()), _LATER).copy()
        r["side"] = table.column("side").to_numpy()
        return pa.Table.from_batches([_batch(*_first(r[np.argsort(r["id"], kind="stable")], limit))])

    tiles = asking.unionByName(telling).groupBy("key", "i", "j").applyInArrow(compare, _FOUND)
    return found.where("key IS NULL OR key = 0").unionByName(tiles)


def reaches(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """Components (node, component) of what is within reach in packed buckets of :func:`partners`, but for buckets that lie in one component of ``roots`` (node,
    component) as a whole, if ``roots`` has at most ``FEW`` nodes, which go to all tasks then."""
    sent = None
    if roots.count() <= FEW:
        t = roots.select("node", "component").toArrow()
        node, component = (t.column(c).to_numpy() for c in ("node", "component"))
        order = np.argsort(node)
        sent = buckets.sparkSession.sparkContext.broadcast((node[order], component[order]))

    def settled(ids: np.ndarray) -> bool:
        if sent is None or not len(sent.value[0]):
            return False
        node, component = sent.value
        at = np.minimum(np.searchsorted(node, ids), len(node) - 1)
        return bool((node[at] == ids).all() and (component[at] == component[at[0]]).all())

    def forest(made: list[np.ndarray]) -> np.ndarray:
        """Edges that connect what the given ones connect, one for each node at most."""
        edges = np.concatenate(made, axis=1)
        ids, at = np.unique(edges, return_inverse=True)
        labels = settle(len(ids), *at.reshape(2, -1))
        other = np.flatnonzero(labels != np.arange(len(ids)))
        return np.stack([ids[other], ids[labels[other]]])

    def stars(batches):
        made, n = [np.empty((2, 0), np.int64)], 0
        for b in batches:
            for raw in b.column("rows"):
                r = np.frombuffer(raw.as_buffer(), _LATER)
                if settled(r["id"]):
                    continue
                labels = np.arange(len(r))
                step = max(1, (1 << 21) // len(r))
                for at in range(0, len(r), step):
                    x, y = np.nonzero(_near(r[at : at + step], r))
                    labels = settle(len(r), at + x, y, labels)
                other = np.flatnonzero(r["id"] != r["id"][labels])
                made.append(np.stack([r["id"][other], r["id"][labels[other]]]))
                n += len(other)
                if n > 1 << 20:
                    made = [forest(made)]
                    n = made[0].shape[1]
                    if n > 1 << 19:  # what is connected further on stays connected by later edges
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in made[0]], names=["u", "v"])
                        made, n = [np.empty((2, 0), np.int64)], 0
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(made)], names=["u", "v"])

    return durable(components(buckets.select("rows").mapInArrow(stars, "u long, v long"), "u", "v"))


def sketch(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each of ``SKETCH`` classes, up to 255: two sets differ in at least as many hashes as their sketches' counts."""
    return np.minimum(np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()


def _alike(u: np.ndarray, v: np.ndarray, similarity: float) -> bool:
    """Whether two sets of hashes have at least this Jaccard similarity."""
    if min(len(u), len(v)) < similarity * max(len(u), len(v)):
        return False
    common = len(np.intersect1d(u, v, assume_unique=True))
    return common >= similarity * (len(u) + len(v) - common)


def distinct(df: DataFrame, key: str = "doc_id", text: str = "text", verify: int = 5, similarity: float = 0.8, limit: int = 1, block: int = 1 << 14) -> DataFrame:
    """``df`` with one row of each group of near duplicates, the one with the smallest ``key``.

    Alike are texts whose sets of ``verify``-word shingles have a Jaccard similarity of at least ``similarity`` (at least 0.8, for which the reach of the keys
    is set); a group is what links of alike texts connect. Texts with equal sets (by a 128-bit hash) are one class. Classes whose wide fingerprints meet, see
    :func:`wide_keys` and :func:`partners`, are candidates; sketches rule most of the others out, and the sets decide. A row's first
    candidate of each bucket comes first. Then what is within reach of each other in buckets with more candidates, and not all in one group by then, meets all against all,
    in blocks of ``TILE`` rows.
    Texts without a word (null, empty) are equal. Rows of one key are told apart by text; a null key comes first. Rows that are alike in both are one, whichever stays.
    """
    if similarity < 0.8:
        raise ValueError("the keys find texts with a similarity of 0.8 or more")
    df, names, to = shielded(df)
    key, text = to[key], to[text]
    rows = prepared(df, key, text)

    def printed(batches):
        for b in bpe.small(batches, 128):
            texts = bpe.texts_of(b.column("_text"))
            sets = [shingles(x, verify) for x in texts]
            same = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            cols = [b.column("_doc"), b.column("_turn"), pa.array(same, pa.binary()), pa.array([wide_print(x) for x in texts], pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array([sketch(x) for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["_doc", "_turn", "same", "print", "n", "sketch"])

    texts = rows.select("_doc", "_turn", F.col(text).alias("_text"))
    made = durable(texts.mapInArrow(printed, "_doc long, _turn int, same binary, print binary, n int, sketch binary"))
    made = made.withColumn("id", F.conv(F.hex(F.substring("same", 1, 8)), 16, -10).cast("long"))
    firsts = made.groupBy("id", "same").agg(F.min(F.struct("_doc", "_turn", "print", "n", "sketch")).alias("first"))
    classes = durable(firsts.select("id", "first.*"))
    share = (1 - similarity) / (1 + similarity)

    def ruled(batches):
        """Pairs that the sketches of their sets allow to be alike."""
        for b in batches:
            if not b.num_rows:
                continue
            u, v = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.int16) for c in ("sx", "sy"))
            n = b.column("nx").to_numpy().astype(np.int64) + b.column("ny").to_numpy()
            yield b.select(["x", "y"]).filter(pa.array(np.abs(u - v).sum(axis=1) <= share * n + 1e-6))

    def hashed(batches):
        for b in bpe.small(batches, 128):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([shingles(x, verify).tobytes() for x in bpe.texts_of(b.column("_text"))], pa.binary())], names=["id", "set"])

    def compared(batches):
        for b in bpe.small(batches):
            near = [_alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in zip(b.column("set").to_pylist(), b.column("other").to_pylist(), strict=True)]
            yield b.select(["x", "y"]).filter(pa.array(near, pa.bool_()))

    def alike(pairs: DataFrame) -> DataFrame:
        """The (x, y) of ``pairs`` that are alike."""
        known = [classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in "xy"]
        likely = durable(pairs.join(known[0], "x").join(known[1], "y").mapInArrow(ruled, "x long, y long"))
        involved = likely.select(F.col("x").alias("id")).union(likely.select("y")).distinct()
        who = durable(classes.join(involved, "id").select("id", F.col("_doc").alias("_d"), F.col("_turn").alias("_t")))
        held = few(texts, who, (F.col("_doc") == F.col("_d")) & (F.col("_turn") == F.col("_t"))).select("id", "_text")
        sets = durable(held.mapInArrow(hashed, "id long, set binary"))
        both = likely.join(sets.withColumnRenamed("id", "x"), "x").join(sets.select(F.col("id").alias("y"), F.col("set").alias("other")), "y")
        out = durable(both.select("x", "y", "set", "other").mapInArrow(compared, "x long, y long"))
        forget(sets)
        return out

    def met(table: pa.Table) -> pa.Table:
        """Links of the rows of a tile that join what has different labels."""
        table = table.sort_by("id")
        ids, label, side = (table.column(c).to_numpy() for c in ("id", "label", "mine"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
        n, sketches = np.array([len(x) for x in sets]), np.frombuffer(b"".join(map(sketch, sets)), np.uint8).reshape(-1, SKETCH).astype(np.int16)
        cross = (side != side[0]).any()
        root: dict[int, int] = {}

        def find(v: int) -> int:
            while v in root:
                v = root[v]
            return v

        out = []
        for at in range(1, len(ids), 32):
            x = slice(at, at + 32)
            may = (label[x, None] != label[None, : at + 31]) & (np.arange(len(ids))[x, None] > np.arange(len(ids))[None, : at + 31])
            if cross:
                may &= side[x, None] != side[None, : at + 31]
            i, j = np.nonzero(may)
            i += at
            apart = [np.abs(sketches[i[k : k + 8192]] - sketches[j[k : k + 8192]]).sum(axis=1) for k in range(0, len(i), 8192)]
            like = np.flatnonzero(np.concatenate(apart) <= share * (n[i] + n[j]) + 1e-6) if apart else np.empty(0, np.int64)
            for u, v in zip(i[like].tolist(), j[like].tolist(), strict=True):
                a, b = find(int(label[u])), find(int(label[v]))
                if a != b and _alike(sets[u], sets[v], similarity):
                    root[max(a, b)] = min(a, b)
                    out.append((int(ids[u]), int(ids[v])))
        return pa.table({"x": pa.array([u for u, _ in out], pa.int64()), "y": pa.array([v for _, v in out], pa.int64())})

    def rest(buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between the components of ``roots`` within what is in reach of each other in crowded buckets: all against all, block by block."""
        near = reaches(buckets, roots).select(F.col("node").alias("id"), F.col("component").alias("reach"))
        known = roots.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        label = durable(near.join(known, F.col("id") == F.col("_n"), "left").select("id", "reach", F.coalesce("_c", "id").alias("label")))
        sizes = label.groupBy("reach").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("blocks"), F.min("label").alias("_low"), F.max("label").alias("_high")).where("_low != _high")
        who = label.join(sizes.select("reach", "blocks"), "reach").join(classes.select("id", F.col("_doc").alias("_d"), F.col("_turn").alias("_t")), "id")
        who = durable(who)
        held = few(texts, who, (F.col("_doc") == F.col("_d")) & (F.col("_turn") == F.col("_t")))
        mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
        names_ = ["id", "reach", "label", "blocks"]

        def with_sets(batches):
            for b in bpe.small(batches, 128):
                sets = [shingles(x, verify).tobytes() for x in bpe.texts_of(b.column("_text"))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names_), pa.array(sets, pa.binary())], names=[*names_, "set"])

        sets = held.select(*names_, "_text").mapInArrow(with_sets, "id long, reach long, label long, blocks int, set binary").withColumn("mine", mine)
        tiles = sets.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "reach", "label", "set", "mine", F.least("mine", "_k").alias("i"), F.greatest("mine", "_k").alias("j"))
        return durable(tiles.groupBy("reach", "i", "j").applyInArrow(met, "x long, y long"))

    found = partners(classes, limit, block)
    links_ = alike(durable(found.where("x IS NOT NULL").select("x", "y").distinct()))
    roots = durable(components(links_, "x", "y"))
    buckets = found.where("rows IS NOT NULL").select("rows")
    if buckets.limit(1).count():
        links_ = links_.unionByName(rest(buckets, roots))
        roots = durable(components(links_, "x", "y"))
    led = made.select("_doc", "_turn", "id").join(roots, F.col("id") == F.col("node"), "left").select("_doc", "_turn", F.coalesce("component", "id").alias("_root"))
    led = durable(led)
    kept = led.groupBy("_root").agg(F.min(F.struct("_doc", "_turn")).alias("_kept")).select(F.col("_root").alias("_of"), "_kept")
    gone = durable(led.join(kept, F.col("_root") == F.col("_of")).where(F.struct("_doc", "_turn") != F.col("_kept")).select(F.col("_doc").alias("_d"), F.col("_turn").alias("_t")))
    is_ = (F.col("_doc") == F.col("_d")) & (F.col("_turn") == F.col("_t"))
    return few(rows, gone, is_, "left_anti").select(*[F.col(to[c]).alias(c) for c in names])
