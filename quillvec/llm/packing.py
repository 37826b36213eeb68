"""Best-fit packing of documents into sequences by bin completion on the histogram of lengths.

There are at most ``limit`` different lengths, however many documents there are. So the search runs on their counts:
a solution is a list of patterns, each a filling of one sequence and how often it is used. The driver sees the histogram
only. Every use of a pattern that is repeated as often as the counts allow exhausts a length, so there are at most
``limit`` patterns, and the places that workers look up are bounded too.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import only, shielded

#: A pattern: runs of equal lengths, (length, copies), and the number of sequences that are filled so.
Pattern = tuple[tuple[tuple[int, int], ...], int]


def best_fit(counts: dict[int, int], limit: int) -> list[Pattern]:
    """Best-fit decreasing on counts: the first incumbent."""
    rooms: list[int] = []  # sorted rooms of open groups
    groups: dict[int, list[list]] = {}  # room: [runs, sequences]

    def put(room: int, runs: tuple, n: int) -> None:
        if n:
            if room not in groups:
                insort(rooms, room)
                groups[room] = []
            groups[room].append([runs, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = limit // length
                full, rest = divmod(left, each)
                put(limit - each * length, ((length, each),), full)
                if rest:
                    put(limit - rest * length, ((length, rest),), 1)
                break
            room = rooms[at]
            runs, n = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = min(room // length, ceil(left / n))
            if each * n > left:  # the last group: some of it takes one fewer
                each = max(1, each - 1) if (each - 1) * n else 1
            used = min(n, left // each)
            put(room - each * length, (*runs, (length, each)), used)
            put(room, runs, n - used)
            left -= used * each
    return [(tuple(runs), n) for room in groups.values() for runs, n in room]


def lower_bound(counts: dict[int, int], limit: int) -> int:
    """The least number of sequences by waste: for each threshold, long documents can't share and leave room only for short ones."""
    lengths = np.array(sorted(counts), dtype=np.int64)
    n = np.array([counts[int(x)] for x in lengths], dtype=np.int64)
    total = lengths * n
    best = -(-int(total.sum()) // limit)
    for t in range(0, limit // 2 + 1):
        long, middle = lengths > limit - t, (lengths <= limit - t) & (lengths > limit // 2)
        short = (lengths >= max(t, 1)) & (lengths <= limit // 2)
        room = int((n[middle] * limit).sum() - total[middle].sum())
        best = max(best, int(n[long].sum() + n[middle].sum()) + max(0, -(-(int(total[short].sum()) - room) // limit)))
    return best


def fillings(lengths: list[int], counts: dict[int, int], room: int, waste: int, nodes: int, width: int) -> list[tuple[int, tuple]]:
    """Undominated fillings of ``room`` that waste at most ``waste``, best first: (waste, runs). ``lengths`` ascend.

    A filling is dominated if a length that is left can stand for one, or two, of its documents and waste less.
    """
    found: list[tuple[int, tuple]] = []
    spent = 0

    def dominated(runs: tuple, spare: int) -> bool:
        taken = dict(runs)
        for i, (a, m) in enumerate(runs):
            subs = [a] + ([2 * a] if m > 1 else []) + [a + b for b, _ in runs[i + 1 :]]
            for s in subs:
                at = bisect_right(lengths, s + spare) - 1
                while at >= 0 and lengths[at] > s:
                    if counts[lengths[at]] > taken.get(lengths[at], 0):
                        return True
                    at -= 1
        return False

    def search(top: int, room: int, runs: tuple) -> bool:
        """True once the search may end."""
        nonlocal spent
        at = min(top, bisect_right(lengths, room)) - 1
        if at < 0:
            if room <= waste and not dominated(runs, room):
                found.append((room, runs))
                return (room == 0 and len(found) >= width // 2) or len(found) >= 8 * width
            return False
        for i in range(at, -1, -1):
            x = lengths[i]
            for m in range(min(counts[x], room // x), 0, -1):
                spent += 1
                if spent > nodes:
                    return True
                if search(i, room - m * x, (*runs, (x, m))):
                    return True
        return False

    if not search(len(lengths), room, ()) and not found and room <= waste and not bisect_right(lengths, room):
        found.append((room, ()))
    return sorted(found, key=lambda f: (f[0], sum(m for _, m in f[1])))[:width]


def complete(counts: dict[int, int], limit: int, steps: int = 6_000, nodes: int = 400, width: int = 6) -> list[Pattern]:
    """Patterns that hold all of ``counts``, in as few sequences as the search finds.

    Branch and bound: the longest document left opens a sequence, each undominated filling around it is a branch, used as
    often as the counts allow; a branch is cut when the waste so far leaves no solution better than the incumbent. The
    incumbent starts as best fit, and each branch that the budget leaves open is closed by best fit. ``steps`` bounds the branches
    of the whole search, ``nodes`` and ``width`` those of one enumeration: more may find a better packing, never a wrong one.
    """
    counts = {k: v for k, v in counts.items() if v}
    if any(k > limit or k < 1 for k in counts):
        raise ValueError("lengths must be from 1 to the limit")
    best = best_fit(counts, limit)
    size, least, total = sum(n for _, n in best), lower_bound(counts, limit), sum(k * v for k, v in counts.items())
    left, lengths = dict(counts), sorted(counts)
    made: list[Pattern] = []
    used = filled = 0

    def change(runs: tuple, times: int) -> None:
        for x, m in runs:
            before = left.get(x, 0)
            left[x] = before - m * times
            if not before:
                insort(lengths, x)
            elif not left[x]:
                lengths.pop(bisect_left(lengths, x))

    def branches() -> Iterator[tuple]:
        x = lengths[-1]
        # What the solution may still waste if it is to be better than the incumbent.
        spare = (size - 1) * limit - total - (used * limit - filled)
        change(((x, 1),), 1)
        options = fillings(lengths, left, limit - x, max(spare, 0), nodes, width) if spare >= 0 else []
        change(((x, 1),), -1)
        for _, runs in options:
            merged: dict[int, int] = {x: 1}
            for y, m in runs:
                merged[y] = merged.get(y, 0) + m
            yield tuple(sorted(merged.items(), reverse=True))

    stack: list[Iterator[tuple]] = []
    deepest = 0
    while size > least:
        if not lengths:
            if used < size:
                best, size = list(made), used
        elif len(stack) == len(made):
            stack.append(branches())
        runs = next(stack[-1], None) if stack and len(stack) > len(made) else None
        if runs is not None and steps > 0:
            steps -= 1
            times = min(left[x] // m for x, m in runs)
            if used + times + -(-(total - filled - times * sum(x * m for x, m in runs)) // limit) < size:
                change(runs, times)
                made.append((runs, times))
                used, filled = used + times, filled + times * sum(x * m for x, m in runs)
                if len(made) > deepest:
                    deepest = len(made)
                    if deepest % 16 == 0:  # incumbents by best fit from here
                        rest = best_fit({x: left[x] for x in lengths}, limit)
                        if (n := used + sum(t for _, t in rest)) < size:
                            best, size = [*made, *rest], n
            continue
        if steps <= 0 and lengths:
            rest = best_fit({x: left[x] for x in lengths}, limit)
            if (n := used + sum(t for _, t in rest)) < size:
                best, size = [*made, *rest], n
        if len(stack) > len(made):
            stack.pop()
        if not made or steps <= 0:
            break
        runs, times = made.pop()
        change(runs, -times)
        used, filled = used - times, filled - times * sum(x * m for x, m in runs)
    return best


def places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks: first rank, pattern's uses, first sequence and first offset; sorted by (length, rank)."""
    rows, rank, sequence = [], {}, 0
    for runs, times in patterns:
        offset = 0
        for x, m in runs:
            low = rank.get(x, 0)
            rows.append((x, low, times, sequence, offset))
            rank[x] = low + m * times
            offset += m * x
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "times", "sequence", "offset"), table.T.copy(), strict=True))


def pieces(df: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text", separator: int = 0) -> DataFrame:
    """Tokens of each document, ended by ``separator`` and cut into pieces of at most ``limit``.

    Rows: key, piece (from 0), start, length, ids (32-bit little-endian). Null and empty texts give the separator alone.
    """
    end = int(separator).to_bytes(4, "little")

    def run(batches):
        its = bpe.codec(path)
        for b in bpe.small(batches):
            rows: list[tuple] = []
            for d, x in zip(b.column(key), its.encode_all(bpe.texts_of(b.column(text))), strict=True):
                ids = np.frombuffer(x, np.int32).astype("<i4", copy=False).tobytes() + end
                n = len(ids) // 4
                rows += [(d, i, s, min(limit, n - s), ids[4 * s : 4 * (s + limit)]) for i, s in enumerate(range(0, n, limit))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [b.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v.as_py() for v in cols[0]], kinds[0]), *(pa.array(c, k) for c, k in zip(cols[1:], kinds[1:], strict=True))], names=[key, "piece", "start", "length", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return only(df, key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids binary")


def pack(df: DataFrame, order: list[str], limit: int = 2048, length: str = "length", **search: int) -> DataFrame:
    """``df`` with sequence_id and offset: each row's place in sequences of at most ``limit``, in as few as the search finds.

    ``df`` must be the same whenever it is read (a written table). ``order`` are columns that tell rows apart; rows that are
    equal in them may change places with each other. Columns named like the results are replaced. Lengths must be 1 to ``limit``. An empty ``df`` gives an empty result.

    Rows get a rank among those of their length: numbered in hashed buckets, about as many as the root of the number of rows,
    so that a length with a third of all rows is spread; then by the counts of the buckets before. Only the histogram reaches the driver.
    """
    df, names, to = shielded(df)
    order, length = [to[c] for c in order], to[length]
    back = [F.col(to[c]).alias(c) for c in names if c not in ("sequence_id", "offset")]
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(length).count().collect()}  # at most ``limit`` rows
    if not counts:
        return df.select(*back, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    table = places(complete(counts, limit, **search))
    buckets = max(1, isqrt(sum(counts.values())))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy(length, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col(length).alias("_length"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    number = F.row_number().over(Window.partitionBy(length, "_bucket").orderBy(*order)).cast("long") - 1
    ranked = dealt.withColumn("_number", number).join(sizes, (F.col(length) == F.col("_length")) & (F.col("_bucket") == F.col("_of")))
    # Each length's intervals as one row, broadcast: as many rows as there are lengths, and the intervals are bounded by the patterns.
    runs: dict[int, list[tuple]] = {}
    for x, *interval in zip(*(table[c].tolist() for c in ("length", "low", "times", "sequence", "offset")), strict=True):
        runs.setdefault(x, []).append(tuple(interval))
    known = df.sparkSession.createDataFrame([(x, [r[0] for r in rs], rs) for x, rs in runs.items()], "_of_length long, _lows array<long>, _runs array<struct<low:long,times:long,sequence:long,offset:long>>")
    placed = ranked.withColumn("_rank", F.col("_number") + F.col("_before")).join(F.broadcast(known), F.col(length) == F.col("_of_length"))
    # The last interval that starts at or before the rank.
    run = F.get("_runs", F.size(F.filter("_lows", lambda low: low <= F.col("_rank"))) - 1)
    placed = placed.withColumn("_run", run).withColumn("_past", F.col("_rank") - F.col("_run.low"))
    sequence = F.col("_run.sequence") + F.col("_past") % F.col("_run.times")
    offset = F.col("_run.offset") + F.floor(F.col("_past") / F.col("_run.times")).cast("long") * F.col(length)
    return placed.select(*back, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
