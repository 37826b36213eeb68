"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; it accepts exactly the token sequences that the merges produce. It starts as the
one that accepts every sequence of base symbols, one state for each symbol that was just read. Each merge
``u v -> w``, in order, adds one gadget:

* a new state ``w`` that is a copy of state ``v``: what may follow ``v`` may follow ``w``;
* a new arc labelled ``w`` beside each arc labelled ``u``, but for the state ``u`` itself if ``u = v``, where the
  leftmost pair would have been merged;
* the arc ``v`` of state ``u`` closes, since the merge has consumed every such pair.

Copies are stored as references to what they copied, with the time of copying, and arcs are filled into a
transition table when they are first used, so the automaton takes memory in proportion to the merges. The
encoding of a word is the only path that spells it. A second table, over symbols, tells which tokens end at a symbol;
so a word is walked symbol by symbol, once.
"""

from __future__ import annotations

import ctypes
import json
import re
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import only

#: Distinct strings whose encoding a worker keeps, in two generations: when the young one is full it becomes the old one. Longer ones are not kept.
WORDS_KEPT, LONGEST_KEPT = 800_000, 40
ARCS_KEPT = 1 << 18  # transitions in a worker's table
_LONG = 64  # symbols of words that are walked alone
# The pre-splitting pattern of such files, for texts of Latin-1 characters in lower case, where it can be said without Unicode classes.
_LETTERS, _NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_LATIN = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_PIECE = 1 << 16  # characters that the library is given at once
_END = "\0"  # marks the end of a word inside the automaton; byte-level symbols never hold it


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies, by rule."""
    out, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class _Slots:
    """A hash table of non-negative numbers in arrays, open addressing; holds half of ``room`` keys at most."""

    def __init__(self, room: int):
        self.bits = max(8, int(room - 1).bit_length())
        self.keys, self.values, self.used = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key; -1 for those that are not there."""
        out, which, slot = np.full(len(keys), -1, np.int32), np.arange(len(keys)), self._slot(keys)
        while len(which):
            there = self.keys[slot]
            hit = there == keys[which]
            out[which[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            which, slot = which[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Puts in distinct keys that are not there yet."""
        self.used += len(keys)
        which, slot = np.arange(len(keys)), self._slot(keys)
        while len(which):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[which[free]]  # of several in one place the last stays
            won = free & (self.keys[slot] == keys[which])
            self.values[slot[won]] = values[which[won]]
            which, slot = which[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)


class MergeAutomaton:
    """The deterministic automaton of a merge list; ``encode_many`` and ``encode`` walk it, ``labels`` has what its arcs emit."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str):
        inner = lambda s: s[: -len(end)] + _END if end and s.endswith(end) else s
        size = max(vocab.values(), default=-1) + 1
        self.ids = {inner(s): i for s, i in vocab.items()}
        self.end = _END if end else ""
        self.labels: list[str | None] = [None] * size
        for s, i in vocab.items():
            self.labels[i] = s
        self.born = array("i", [-1]) * size  # time at which a state and the arcs of its label came
        self.copied_state, self.copied_label = array("i", [-1]) * size, array("i", [-1]) * size
        self.alive = bytearray([1]) * size
        self.closed: dict[int, int] = {}  # state << 32 | label: time at which a merge closed this arc
        self.table = _Slots(2 * ARCS_KEPT)  # transitions that were asked for: state << 32 | label
        for time, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self._gadget(time, self.ids[inner(a)], self.ids[inner(b)], self.ids[inner(a + b)])
        self.ids = {s: i for s, i in self.ids.items() if self.alive[i]}
        self.longest: dict[str, int] = {}  # length of the longest token with these two last symbols
        for s in self.ids:
            if len(s) > self.longest.get(s[-2:], 0):
                self.longest[s[-2:]] = len(s)
        self._compile()

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0:
            raise ValueError(f"two merges make token {w}")
        self.born[w], self.copied_label[w], self.copied_state[w] = time, u, v
        # Without the two arcs in a row there is nothing to merge, and the token never occurs.
        self.alive[w] = self.alive[u] and self.alive[v] and self._open(u, v, time)
        self.closed[u << 32 | v] = time

    def _compile(self) -> None:
        """The table of symbols: where each place of it goes on a symbol, the token that ends there, the next shorter one, and where to go on if nothing is there."""
        goto: dict[int, int] = {}  # place << 16 | symbol
        of, up, token, depth = [0], [0], [-1], [0]
        for s, t in self.ids.items():
            node = 0
            for c in map(ord, s):
                to = goto.get(node << 16 | c)
                if to is None:
                    to = goto[node << 16 | c] = len(up)
                    up.append(node)
                    of.append(c)
                    token.append(-1)
                    depth.append(depth[node] + 1)
                node = to
            token[node] = t
        fail, term = [0] * len(up), [0] * len(up)
        for node in sorted(range(1, len(up)), key=depth.__getitem__):
            back, to = up[node], None
            while back and to is None:
                back = fail[back]
                to = goto.get(back << 16 | of[node])
            fail[node] = to or 0
            term[node] = node if token[node] >= 0 else term[fail[node]]
        self.depth, self.token, self.fail, self.term = (np.array(x, np.int32) for x in (depth, token, fail, term))
        self.goto = _Slots(2 * len(goto) + 2)
        self.goto.add(np.fromiter(goto, np.int64, len(goto)), np.fromiter(goto.values(), np.int32, len(goto)))

    def _arcs(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Whether the finished automaton has each of these arcs, from the transition table; new ones are worked out and put into it."""
        key = states.astype(np.int64) << 32 | labels
        out = self.table.find(key)
        new = np.flatnonzero(out < 0)
        if len(new):
            asked, at = np.unique(key[new], return_inverse=True)
            open_ = np.array([self._open(k >> 32, k & 0xFFFFFFFF, 1 << 62) for k in asked.tolist()], np.int32)
            out[new] = open_[at]
            if self.table.used + len(asked) > ARCS_KEPT:
                self.table = _Slots(2 * ARCS_KEPT)
            if len(asked) <= ARCS_KEPT:
                self.table.add(asked, open_)
        return out > 0

    def encode_many(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-split words of byte symbols, one after the other, and where each word's begin (and the last one's end).

        All words are walked symbol by symbol together. Every beginning of a path is the path of what it spells, and there is one path only. So the
        state after the first ``i`` symbols is the one token that ends there and that an arc leads to from the state where it starts; nothing is
        ever taken back. An empty word has no ids.
        """
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        lengths[lengths > 0] += len(self.end)
        out, at = np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        if not lengths.any():
            return out, at
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        codes = np.frombuffer("".join([w + self.end for w in words if w]).encode("utf-16-le"), np.uint16).astype(np.int64)
        first = (np.cumsum(lengths) - lengths)[order]
        top = int(size[0])
        states, starts = np.full((top + 1, n), -1, np.int32), np.zeros((top + 1, n), np.int32)
        nodes = np.zeros(n, np.int64)
        for i in range(1, top + 1):
            live = int(np.searchsorted(-size, -i, side="right"))
            c = codes[first[:live] + i - 1]
            which, cur, to = np.arange(live), nodes[:live], np.zeros(live, np.int64)
            while len(which):
                v = self.goto.find(cur << 16 | c[which])
                to[which[v >= 0]] = v[v >= 0]
                on = (v < 0) & (cur > 0)
                which, cur = which[on], self.fail[cur[on]].astype(np.int64)
            nodes[:live] = to
            which, e = np.arange(live), self.term[to]
            while len(which):
                which, e = which[e > 0], e[e > 0]
                k, t = i - self.depth[e], self.token[e]
                s = states[k, which]
                good = k == 0
                ask = np.flatnonzero(s >= 0)
                good[ask] = self._arcs(s[ask], t[ask])
                states[i, which[good]], starts[i, which[good]] = t[good], k[good]
                which, e = which[~good], self.term[self.fail[e[~good]]]
        col = np.arange(n)
        if (bad := (size > 0) & (states[size, col] < 0)).any():
            raise ValueError(f"no path spells {words[order[bad][0]]!r}")
        found, pos = [], size
        which = np.flatnonzero(pos > 0)
        while len(which):
            found.append((which, states[pos[which], which]))
            pos = pos.copy()
            pos[which] = starts[pos[which], which]
            which = which[pos[which] > 0]
        count = np.zeros(n, np.int64)
        for which, _ in found:
            count[order[which]] += 1
        at[1:] = np.cumsum(count)
        out = np.empty(int(at[-1]), np.int32)
        for back, (which, t) in enumerate(found, 1):
            out[at[order[which] + 1] - back] = t
        return out, at

    def encode(self, word: str) -> list[int]:
        """Ids of one pre-split word of byte symbols, by the same walk as :meth:`encode_many`: for words so long that few stand beside them."""
        text = word + self.end if word else ""
        n, ids, longest = len(text), self.ids, self.longest
        states, starts = [-1] * (n + 1), [0] * (n + 1)
        known: dict[tuple[int, int], bool] = {}
        for i in range(1, n + 1):
            for k in range(max(0, i - longest.get(text[max(0, i - 2) : i], 1)), i):
                t = ids.get(text[k:i])
                if t is None or k and states[k] < 0:
                    continue
                if k:
                    arc = states[k], t
                    if arc not in known:
                        known[arc] = self._open(*arc, 1 << 62)
                    if not known[arc]:
                        continue
                states[i], starts[i] = t, k
                break
        if n and states[n] < 0:
            raise ValueError(f"no path spells {word[:80]!r}")
        path: list[int] = []
        while n:
            path.append(states[n])
            n = starts[n]
        path.reverse()
        return path

    def _open(self, s: int, x: int, until: int) -> bool:
        """Whether the arc ``x`` of state ``s`` is there at a time, both having come before."""
        born = self.born
        while True:
            if self.closed.get(s << 32 | x, until) < until:
                return False
            bs, bx = born[s], born[x]
            if bs < 0 and bx < 0:
                return True
            if s == x:  # both came with one gadget
                until, s, x = bs, self.copied_state[s], self.copied_label[x]
            elif bs > bx:
                until, s = bs, self.copied_state[s]
            elif self.copied_label[x] == self.copied_state[x] == s:
                return False
            else:
                until, x = bx, self.copied_label[x]


class _Kept:
    """Encodings of strings, in two generations."""

    def __init__(self) -> None:
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.passing: list[str] = []  # long ones, which the next call drops

    def take(self, strings: set[str], make) -> dict[str, bytes]:
        """A map that has the encodings of some strings until the next call; those that are not kept are made by ``make`` (of a list), all at once."""
        for x in self.passing:
            del self.young[x]
        if len(self.young) >= WORDS_KEPT // 2:
            self.young, self.old = {}, self.young
        young, old, fresh = self.young, self.old, []
        for x in strings.difference(young):
            if (ids := old.get(x)) is None:
                fresh.append(x)
            else:
                young[x] = ids
        for at in range(0, len(fresh), 1 << 14):
            some = fresh[at : at + (1 << 14)]
            young.update(zip(some, make(some), strict=True))
        self.passing = [x for x in fresh if len(x) > LONGEST_KEPT]
        return young


class Codec:
    """Normalises, pre-splits and encodes texts as a word-end BPE file of the tokenizers library says; keeps encoded words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE with word ends is supported")
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.latin = steps == ["NFC", "Replace", "Lowercase"] and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == _SPLIT
        self.automaton = MergeAutomaton(model["vocab"], model["merges"], model["end_of_word_suffix"])
        library = Tokenizer.from_str(json.dumps(spec | {"model": model | {"vocab": {}, "merges": [], "unk_token": None}, "added_tokens": [], "post_processor": None}))  # without the tables
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.symbols = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.labels = list(self.automaton.labels)
        for s, i in self.special.items():
            self.labels += [None] * (i + 1 - len(self.labels))
            self.labels[i] = s
        self.lows, self.words = _Kept(), _Kept()

    def _lows(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case Latin words."""
        table = self.symbols
        return self._words([w if w.isascii() and w.isprintable() else "".join([table[b] for b in w.encode()]) for w in words])

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of byte symbols."""
        flat, at = self.automaton.encode_many([w if len(w) <= _LONG else "" for w in words])
        raw, ends = flat.tobytes(), (4 * at).tolist()
        return [raw[a:z] if len(w) <= _LONG else array("i", self.automaton.encode(w)).tobytes() for w, a, z in zip(words, ends, ends[1:], strict=False)]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as 32-bit integers of this machine's byte order."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as 32-bit integers of this machine's byte order."""
        parts: list[list] = []  # of each text: ids, or lists of words and whether they are Latin
        for text in texts:
            if self.cut and "<" in text and len(pieces := self.cut.split(text)) > 1:
                parts.append([array("i", [self.special[p]]).tobytes() if p in self.special else self._plain(p) for p in pieces])
            else:
                parts.append([self._plain(text)])
        latin = self.lows.take(set().union(*[p[1] for ps in parts for p in ps if type(p) is tuple and p[0]]), self._lows)
        other = self.words.take(set().union(*[p[1] for ps in parts for p in ps if type(p) is tuple and not p[0]]), self._words)
        return [b"".join([p if type(p) is bytes else b"".join(map((latin if p[0] else other).__getitem__, p[1])) for p in ps]) for ps in parts]

    def _plain(self, text: str) -> tuple[bool, list[str]]:
        """What a text without special tokens consists of: lower-case Latin words, or words of byte symbols."""
        if self.latin:
            try:
                text.encode("latin-1")  # such a text is in form NFC, and the Unicode versions at hand agree about it
            except UnicodeEncodeError:
                pass
            else:
                return True, _LATIN.findall(text.lower())
        # White space parts words in any case, so the library may split a long text piece by piece.
        return False, [w for at in range(0, len(text), _PIECE) for w in self._split(text, at)]

    def _split(self, text: str, at: int) -> list[str]:
        """Words of byte symbols of the blank-ended pieces that start in one stretch of a text."""
        start = 0 if not at else text.find(" ", at - 1) + 1
        end = len(text) if at + _PIECE >= len(text) or (end := text.find(" ", at + _PIECE - 1)) < 0 else end + 1
        if at and not start or start >= end:
            return []
        return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text[start:end]))]

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """What the arcs emit for each list of ids, parted by blanks: such files have no decoder, so the library joins the labels.

        Null lists give an empty text; null ids and ids outside the vocabulary give nothing.
        """
        offsets = ids.offsets.to_numpy()
        flat = ids.flatten() if not ids.null_count else pa.compute.fill_null(ids, pa.scalar([], ids.type)).flatten()
        if ids.null_count:
            offsets = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(ids), 0).to_numpy())))
        offsets = offsets - offsets[0]
        emitted = pa.array(self.labels, pa.large_string())
        at = flat.to_numpy(zero_copy_only=False)
        good = np.isfinite(at) & (at >= 0) & (at < len(self.labels))
        if flat.null_count or not good.all():
            at = np.where(good, at, 0).astype(np.int64)
            good &= emitted.is_valid().to_numpy(zero_copy_only=False)[at]
            offsets = np.concatenate(([0], np.cumsum(good)))[offsets]
            at = at[good]
        return pa.compute.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), emitted.take(pa.array(at))), pa.scalar(" ", pa.large_string())).cast(pa.string())


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One for each worker process and file."""
    return Codec(path)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded size, so that texts are not all held as Python strings at once. Free memory goes back to the machine at the end."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # workers live on between tasks


def ids_array(parts: list[bytes]) -> pa.Array:
    offsets, at = array("i", [0]), 0
    for p in parts:
        at += len(p) // 4
        offsets.append(at)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(parts))]))


def encode(df: DataFrame, path: str, text: str = "text", to: str = "ids", keep: list[str] | None = None, decoded: str | None = None) -> DataFrame:
    """Columns ``keep`` (all, unless given) of ``df`` and ``to``: the ids of each whole text; with ``decoded``, also the text that they decode to.

    Null and empty texts give an empty list. One narrow pass over the rows, no shuffle. ``path`` must be
    readable on every worker. Columns named like the results are replaced.
    """
    made = [to] if decoded is None else [to, decoded]
    keep = [c for c in (df.columns if keep is None else keep) if c not in made]
    source = only(df, *dict.fromkeys([*keep, text]))

    def run(batches):
        its = codec(path)
        for b in small(batches):
            ids = ids_array(its.encode_all(texts_of(b.column(text))))
            out = [ids] if decoded is None else [ids, its.decode(ids)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *out], names=[*keep, *made])

    schema = source.select(*keep).schema.add(to, T.ArrayType(T.IntegerType()))
    return source.mapInArrow(run, schema if decoded is None else schema.add(decoded, T.StringType()))


def decode(df: DataFrame, path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``df`` with ``to``: the text of each list of ids; see :meth:`Codec.decode`."""
    keep = [c for c in df.columns if c != to]

    def run(batches):
        its = codec(path)
        for b in small(batches):
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), its.decode(b.column(ids))], names=[*keep, to])

    return df.select(*keep).mapInArrow(run, df.select(*keep).schema.add(to, "string"))


def digests(ids: str = "ids", decoded: str = "decoded") -> list[Column]:
    return [
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    ]
