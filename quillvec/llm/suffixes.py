"""Exact substring dedup: bytes covered by a long string that starts earlier are removed.

Equal windows of ``size`` bytes have the same minimizer, the least hash among their k-grams. Consecutive windows with one
minimizer form a run, so a corpus has a few runs for every hundred bytes. Runs are dealt by their minimizer's hash:

1. of runs that are equal byte for byte, all but the first are repeats;
2. different runs under one minimizer may share some windows. They are cut into quarters, dealt by a core of bytes that all windows of a quarter
   hold, and compared as in 1; what is still different under one core goes, block by block, through a suffix array, in whose order equal windows are
   neighbours and the earliest of them stays.

The suffix array is built by linear grouping: suffixes are grouped by their Lyndon prefix, groups in descending order refine smaller ones by pointers to the
previous smaller suffix, then each group's order is emitted from the smallest suffix on, without recursive renaming.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import durable, prepared, shielded

GRAM = 32
QUARTERS = 4
CHUNK = 1 << 20  # bytes of documents that are hashed at once
BLOCK = 1 << 16  # bytes of a suffix array


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffix array of non-negative integers by linear grouping of Lyndon prefixes."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    # Groups by first symbol, in a linked list from small to large; a symbol below all others ends the text.
    values, first = np.unique(text, return_inverse=True)
    group = (first + 1).tolist() + [0]
    members: list[list[int]] = [[] for _ in range(len(values) + 1)]
    for i, g in enumerate(group):
        members[g].append(i)
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members))) + [-1]
    back = [-1] * (n + 1)  # pointer to the previous suffix of a smaller group
    jump = list(range(-1, n))  # steps in search of it, shortened as they are used
    done = bytearray(n + 1)
    g = len(members) - 1
    while g >= 0:
        mine = [i for i in members[g] if group[i] == g]
        members[g] = mine
        for i in mine:
            done[i] = 1
        times: dict[int, int] = {}
        for i in mine:
            p = i - 1
            while p >= 0 and done[p]:
                q = jump[p]
                if q >= 0 and done[q]:
                    jump[p] = jump[q]
                p = q
            back[i] = jump[i] = p
            times[p] = times.get(p, 0) + 1
        times.pop(-1, None)
        if times:
            if max(times.values()) == 1:
                rounds = [list(times)]
            else:
                by: dict[int, list[int]] = {}
                for p, k in times.items():
                    by.setdefault(k, []).append(p)
                rounds = [by[k] for k in sorted(by, reverse=True)]
            for part in rounds:
                fresh: dict[int, int] = {}
                for p in part:
                    old = group[p]
                    new = fresh.get(old)
                    if new is None:
                        new = fresh[old] = len(members)
                        members.append([])
                        up = above[old]
                        above.append(up)
                        below.append(old)
                        above[old] = new
                        if up >= 0:
                            below[up] = new
                    group[p] = new
                    members[new].append(p)
        g = below[g]
    # Emit: the order inside a group is the order of the suffixes that follow the Lyndon prefixes.
    start, at, g = [0] * len(members), 0, 0
    while g >= 0:
        start[g] = at
        at += len(members[g])
        g = above[g]
    out = [-1] * (n + 1)
    out[0] = n
    placed = bytearray(n + 1)
    placed[n] = 1
    for i in range(n + 1):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            g = group[j]
            out[start[g]] = j
            start[g] += 1
            j = back[j]
    return np.array(out[1:], np.int64)


def runs(texts: list[bytes], size: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows of some documents: document, first window, windows, minimizer's place, its hash; by document and place."""
    gram = min(GRAM, size)
    span = size - gram + 1
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(data) < size:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    # Hashes of all k-grams by doubling, after the binary digits of k.
    one = data.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    full, length, power = None, 0, np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        scale, have, bit = power, one, 1  # hashes of ``bit`` symbols, and the factor that moves past them
        rest = np.uint64(1)
        while bit <= gram:
            if gram & bit:
                if full is None:
                    full, rest = have, scale
                else:
                    m = len(data) - length - bit + 1
                    full = full[:m] * scale + have[length : length + m]
                    rest = rest * scale
                length += bit
            have = have[: len(have) - bit] * scale + have[bit:]
            scale = scale * scale
            bit *= 2
        full = (full ^ (full >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    full ^= full >> np.uint64(32)
    least = (full & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(full), dtype=np.uint64)  # the leftmost of equals
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[: len(least) - width], least[width:])
        width *= 2
    windows = len(data) - size + 1
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(ends, np.arange(windows), side="right")
    valid = np.arange(windows) + size <= ends[doc]
    cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1]))))
    count = np.diff(np.append(cut, windows))
    keep = valid[cut]
    cut, count = cut[keep], count[keep]
    starts = np.concatenate(([0], ends[:-1]))
    return doc[cut], cut - starts[doc[cut]], count, place[cut] - starts[doc[cut]], full[place[cut]]


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unions of overlapping or touching intervals, in order."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate(([True], starts[1:] > ends[:-1]))
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


ROW = "key long, same long, doc long, turn int, start int, n int, at int, cover boolean, bytes binary"
_NAMES = ["key", "same", "doc", "turn", "start", "n", "at", "cover", "bytes"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def _batch(*columns) -> pa.RecordBatch:
    n = len(columns[2])
    fill = lambda c, k: pa.nulls(n, k) if c is None else pa.array(np.full(n, c) if np.isscalar(c) else c, k)
    return pa.RecordBatch.from_arrays([fill(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


def _combined(key, same, doc, turn, start, n, at, data, size: int) -> Iterator[pa.RecordBatch]:
    """Rows for the next step; of rows that are equal here already, the first stays, the others are covered."""
    if not len(doc):
        return
    order = np.lexsort((start, turn, doc, same, key))
    first = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (same[order][1:] != same[order][:-1])))
    keep, gone = order[first], order[~first]
    yield _batch(key[keep], same[keep], doc[keep], turn[keep], start[keep], n[keep], at[keep], False, None if data is None else [data[i] for i in keep.tolist()])
    yield from _covers(doc[gone], turn[gone], start[gone], start[gone] + n[gone] + size - 1)


def _covers(doc, turn, start, end) -> Iterator[pa.RecordBatch]:
    if len(doc):
        # Intervals of each document in one go, documents set apart.
        order = np.lexsort((turn, doc))
        d, t = doc[order], turn[order]
        which = np.cumsum(np.concatenate(([0], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))).astype(np.int64) << np.int64(32)
        a, b = joined(which + start[order], which + end[order])
        who = np.searchsorted(which, a >> np.int64(32) << np.int64(32))
        a, b = a & np.int64(0xFFFFFFFF), b & np.int64(0xFFFFFFFF)
        yield _batch(_signed(np.asarray(d[who]).astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), 0, d[who], t[who], a, b - a, 0, True, None)


def _columns(batch) -> list[np.ndarray]:
    return [np.array(batch.column(c).to_numpy(zero_copy_only=False)) for c in ("key", "same", "doc", "turn", "start", "n", "at")]


def _scan(batches, size: int) -> Iterator[tuple]:
    """Rows sorted by key, same, doc, turn, start, in pieces: covers as batches, and (columns, bytes) of first rows whose key has others."""
    last = (None, None)
    held = None  # the only first row of the last key so far
    many = False
    for batch in batches:
        for cover in (True, False):
            part = batch.filter(batch.column("cover") if cover else pa.compute.invert(batch.column("cover")))
            if not part.num_rows:
                continue
            if cover:
                yield part, None, None
                continue
            cols = _columns(part)
            key, same = cols[0], cols[1]
            fresh = np.concatenate(([(key[0], same[0]) != last], (key[1:] != key[:-1]) | (same[1:] != same[:-1])))
            gone = ~fresh
            for c in _covers(cols[2][gone], cols[3][gone], cols[4][gone], cols[4][gone] + cols[5][gone] + size - 1):
                yield c, None, None
            kept = part.filter(pa.array(fresh))
            if kept.num_rows:
                if held is not None:
                    kept = pa.Table.from_batches([held, kept]).combine_chunks().to_batches()[0]
                k = kept.column("key").to_numpy()
                pair = k[1:] == k[:-1]
                shared = np.concatenate((pair, [False])) | np.concatenate(([many and held is None and last[0] == k[0]], pair))
                wait = not shared[-1]
                if wait:
                    shared[-1] = False
                if shared.any():
                    rows = kept.filter(pa.array(shared))
                    yield None, _columns(rows), rows.column("bytes").to_pylist()
                held, many = (kept.slice(kept.num_rows - 1), False) if wait else (None, True)
            last = (key[-1], same[-1])


def _same(rows: list[tuple], size: int) -> tuple[list, list, list, list]:
    """Intervals (doc, turn, start, end) of windows that equal an earlier one, among rows (doc, turn, start, bytes)."""
    rows = sorted(rows, key=lambda r: r[:3])
    data = np.frombuffer(b"".join(r[3] + b"\0" for r in rows), np.uint8)
    text = data.astype(np.int64) + 2
    ends = np.cumsum([len(r[3]) + 1 for r in rows])
    text[ends - 1] = 1  # parts the rows; below any byte
    order = suffix_array(text)
    row = np.searchsorted(ends, order, side="right")
    order, row = (x[order + size < ends[row]] for x in (order, row))  # suffixes that start a whole window
    if not len(order):
        return [], [], [], []
    views = np.lib.stride_tricks.sliding_window_view(text, size)
    pairs = range(0, len(order) - 1, 4096)
    equal = np.concatenate([np.zeros(1, bool), *[(views[order[:-1][i : i + 4096]] == views[order[1:][i : i + 4096]]).all(axis=1) for i in pairs]])
    which = np.cumsum(~equal)
    # Rows are in order, so a smaller place in the text is an earlier window.
    first = np.full(which[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(first, which, order)
    later = order != first[which]
    begins = np.concatenate(([0], ends[:-1]))
    r = row[later]
    start = order[later] - begins[r] + np.array([x[2] for x in rows], np.int64)[r]
    return np.array([x[0] for x in rows], np.int64)[r], np.array([x[1] for x in rows], np.int32)[r], start, start + size


def repeats(df: DataFrame, size: int = 100, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Rows (doc, turn, spans): for each document with repeats, sorted disjoint byte intervals covered by earlier strings of ``size`` bytes.

    ``turn`` counts rows of one ``key`` from 0, by text; see :func:`prepared`.
    """
    gram = min(GRAM, size)
    span = size - gram + 1

    def hashed(batches):
        for b in bpe.small(batches, 4096):
            ids, turns = (np.array(b.column(c).to_numpy(zero_copy_only=False)) for c in ("doc", "turn"))
            held: list[bytes] = []
            made: list[tuple] = []
            at = 0
            for i, x in enumerate(bpe.texts_of(b.column("text"))):
                held.append(x.encode())
                if sum(map(len, held)) >= CHUNK or i == b.num_rows - 1:
                    d, s, n, p, h = runs(held, size)
                    digest = xxhash.xxh3_64_intdigest
                    same = np.fromiter((digest(held[j][a : a + m + size - 1]) for j, a, m in zip(d.tolist(), s.tolist(), n.tolist(), strict=True)), np.uint64, len(d))
                    made.append((_signed(h), _signed(same), ids[at + d], turns[at + d], s, n, p - s))
                    at, held = i + 1, []
            if made:
                yield from _combined(*(np.concatenate(z) for z in zip(*made, strict=True)), None, size)

    def first_scan(batches):
        for covers, rows, _ in _scan(batches, size):
            yield covers if rows is None else _batch(*rows, False, None)

    docs = df.select(F.col("_doc").alias("doc"), F.col("_turn").alias("turn"), F.col(text).alias("text"))
    order = ["key", "same", "doc", "turn", "start"]
    one = durable(docs.mapInArrow(hashed, ROW).repartition("key").sortWithinPartitions(*order).mapInArrow(first_scan, ROW))
    open_ = one.where(~F.col("cover")).groupBy("doc", "turn").agg(F.collect_list(F.struct("start", "n", "at")).alias("runs"))

    def parted(batches):
        """Quarters of the open runs, with their bytes, by the bytes that all windows of a quarter hold."""
        digest = xxhash.xxh3_64_intdigest
        for b in bpe.small(batches):
            made: list[tuple] = []
            for doc, turn, x, found in zip(b.column("doc").to_pylist(), b.column("turn").to_pylist(), bpe.texts_of(b.column("text")), b.column("runs").to_pylist(), strict=True):
                data = x.encode()
                for r in found:
                    place = r["start"] + r["at"]
                    for q in range(QUARTERS):
                        # Windows that start from ``far`` down to ``near`` bytes before the minimizer.
                        near, far = q * span // QUARTERS, (q + 1) * span // QUARTERS - 1
                        a, z = max(r["start"], place - far), min(r["start"] + r["n"] - 1, place - near)
                        if a <= z:
                            core = data[place - near : place - far + size]
                            part = data[a : z + size]
                            made.append((digest(core, q), digest(part, q), doc, turn, a, z - a + 1, 0, part))
            if made:
                k, s, d, t, a, n, p, part = zip(*made, strict=True)
                arrays = [_signed(np.array(v, np.uint64)) for v in (k, s)] + [np.array(v, np.int64) for v in (d, t, a, n, p)]
                yield from _combined(*arrays, part, size)

    def last_scan(batches):
        """Suffix arrays over rows of whole keys, about ``block`` bytes at a time; rows of a key beyond that are passed on open."""
        held: list[tuple] = []
        weight, big = 0, None

        def flush(rows):
            groups: dict[int, int] = {}
            for r in rows:
                groups[r[0]] = groups.get(r[0], 0) + 1
            use = [r[1:] for r in rows if groups[r[0]] > 1]
            if use:
                yield from _covers(*(np.asarray(z) for z in _same(use, size)))

        def passed(rows):
            k, d, t, a, p = (list(z) for z in zip(*rows, strict=True))
            zero = np.zeros(len(k), np.int64)
            yield _batch(np.array(k, np.int64), zero, np.array(d), np.array(t), np.array(a), np.array([len(x) - size + 1 for x in p]), zero, False, p)

        for covers, rows, data in _scan(batches, size):
            if rows is None:
                yield covers
                continue
            for r in zip(rows[0].tolist(), rows[2].tolist(), rows[3].tolist(), rows[4].tolist(), data, strict=True):
                if r[0] == big:
                    yield from passed([r])
                    continue
                if held and r[0] != held[-1][0] and weight >= block:
                    yield from flush(held)
                    held, weight = [], 0
                held.append(r)
                weight += len(r[4])
                if weight >= 4 * block:
                    big = r[0]
                    mine = [x for x in held if x[0] == big]
                    yield from flush([x for x in held if x[0] != big])
                    yield from passed(mine)
                    held, weight = [], 0
        yield from flush(held)

    # What a big key passed on is cut into single windows, each of which is dealt by its own bytes.
    def single(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in bpe.small(batches, 2048):
            made = [
                (digest(p[i : i + size], 1), digest(p[i : i + size], 2), d, t, a + i, 1, 0)
                for d, t, a, p in zip(*(b.column(c).to_pylist() for c in ("doc", "turn", "start", "bytes")), strict=True)
                for i in range(len(p) - size + 1)
            ]
            k, s, *rest = zip(*made, strict=True)
            yield from _combined(*[_signed(np.array(v, np.uint64)) for v in (k, s)], *[np.array(v, np.int64) for v in rest], None, size)

    def only_covers(batches):
        for covers, rows, _ in _scan(batches, size):
            if rows is None:
                yield covers

    two = docs.join(open_, ["doc", "turn"]).mapInArrow(parted, ROW)
    two = durable(two.repartition("key").sortWithinPartitions(*order).mapInArrow(last_scan, ROW))
    covers = one.where("cover").unionByName(two.where("cover"))
    big = two.where(~F.col("cover"))
    if big.limit(1).count():
        three = big.mapInArrow(single, ROW).repartition("key").sortWithinPartitions(*order).mapInArrow(only_covers, ROW)
        covers = covers.unionByName(durable(three))
    return covers.groupBy(F.col("doc").alias("_d"), F.col("turn").alias("_t")).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"))


def dedup(df: DataFrame, size: int = 100, key: str = "doc_id", text: str = "text", keep: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Columns ``keep`` (all but the text, unless given), n_bytes, spans (removed byte intervals), rest (the bytes that stay).

    A byte is removed if a string of ``size`` bytes that covers it also starts earlier: in a smaller ``key``, or earlier in the same text. Null texts
    are empty; texts shorter than ``size`` stay. Rows of one key follow each other by text; a null key comes first. Whole texts are compared,
    as UTF-8, as they came in.
    """
    keep = [c for c in df.columns if c != text] if keep is None else keep
    kinds = [df.schema[c].dataType.simpleString() for c in keep]
    df, _, to = shielded(df)
    rows = prepared(df, to[key], to[text])
    key, text = to[key], to[text]
    found = repeats(rows, size, key, text, block)
    full = rows.select(*[F.col(to[c]).alias(f"k_{i}") for i, c in enumerate(keep)], "_doc", "_turn", F.col(text).alias("text"))
    both = full.join(found, (F.col("_doc") == F.col("_d")) & (F.col("_turn") == F.col("_t")), "left").select(*[f"k_{i}" for i in range(len(keep))], "text", "spans")

    def cut(batches):
        for b in bpe.small(batches):
            sizes, spans, rests = [], [], []
            for x, found in zip(bpe.texts_of(b.column("text")), b.column("spans").to_pylist(), strict=True):
                data = x.encode()
                a, z = joined(np.array([f["start"] for f in found]), np.array([f["end"] for f in found])) if found else (np.empty(0, int), np.empty(0, int))
                a, z = a.tolist(), z.tolist()
                sizes.append(len(data))
                spans.append([{"start": i, "end": j} for i, j in zip(a, z, strict=True)])
                rests.append(b"".join(data[i:j] for i, j in zip([0, *z], [*a, len(data)], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*(b.column(f"k_{i}") for i in range(len(keep))), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(rests, pa.binary())], names=[*(f"k_{i}" for i in range(len(keep))), "n_bytes", "spans", "rest"])

    schema = ", ".join([*(f"k_{i} {kind}" for i, kind in enumerate(kinds)), "n_bytes long, spans array<struct<start:long,end:long>>, rest binary"])
    made = both.mapInArrow(cut, schema)
    return made.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "spans", "rest")
