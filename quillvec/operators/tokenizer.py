"""Greedy longest-match tokenizers: Metaspace and WordPiece.

Two strategies that agree: a trie in an Arrow batch function, built once per worker, which keeps the pieces of the words it has met; and a regular
expression in the JVM, for small vocabularies where no Python may run.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillvec.functions.text import words

TOKENS = ArrayType(StructType([StructField("key", StringType()), StructField("id", IntegerType())]))
WORDS_KEPT = 200_000  # words whose pieces a worker keeps
PART_BYTES = 1 << 20  # of texts that a worker tokenises at once, or one text
_SPLIT = re.compile("[^ \t\n\x0b\x0c\r]+")


@dataclass(frozen=True)
class TokenizerModel:
    """Vocabulary and rules. ``kind`` is "Metaspace" (``prefix`` goes before each word) or "WordPiece" (``prefix`` marks pieces inside a word)."""

    kind: str
    prefix: str
    unk_token: str
    unk_id: int
    vocab: dict[str, int] = field(hash=False)

    @classmethod
    def from_vocab(cls, vocab: dict[str, int], kind: str = "Metaspace", prefix: str | None = None, unk_token: str | None = None, compat: str = "intended") -> TokenizerModel:
        """ValueError if the vocabulary is not a map, the unknown token is not in it, or the kind is another one.

        Without ``unk_token``: ``[UNK]`` with id 1 for WordPiece, else ``<unk>`` with id 0, in the vocabulary or not.
        ``compat="legacy"`` takes any other kind as one that prefixes words with ``##``.
        """
        if not isinstance(vocab, dict):
            raise ValueError("the vocabulary must map tokens to ids")
        if kind not in ("Metaspace", "WordPiece"):
            if compat != "legacy":
                raise ValueError(f"unsupported decoder {kind}")
            prefix = "##"
        if prefix is None:
            prefix = "##" if kind == "WordPiece" else "▁"
        if unk_token is None:
            unk_token, unk_id = ("[UNK]", 1) if kind == "WordPiece" else ("<unk>", 0)
        elif unk_token not in vocab:
            raise ValueError(f"the unknown token {unk_token!r} is not in the vocabulary")
        else:
            unk_id = vocab[unk_token]
        return cls(kind, prefix, unk_token, unk_id, dict(vocab))

    @classmethod
    def load(cls, path: str, compat: str = "intended") -> TokenizerModel:
        """From a tokenizer.json: decoder.type, its replacement or prefix, model.unk_token and model.vocab; the rest of the file is not used."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        decoder, model = spec.get("decoder") or {}, spec.get("model") or {}
        if "type" not in decoder:
            raise ValueError("the file names no decoder type")
        prefix = decoder.get("replacement") if decoder["type"] == "Metaspace" else decoder.get("prefix")
        return cls.from_vocab(model.get("vocab"), decoder["type"], prefix, model.get("unk_token"), compat)

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.vocab.items()), "token string, id int")

    # -- the sequential rule, one word at a time

    def _pieces(self) -> tuple[dict, dict]:
        """Tries of pieces that start a word, and of pieces that go on inside one."""
        inside = self.vocab if self.kind != "WordPiece" else {t[len(self.prefix) :]: i for t, i in self.vocab.items() if t.startswith(self.prefix) and len(t) > len(self.prefix)}
        return _trie(self.vocab), _trie(inside)

    def tokens(self, text: str, tries: tuple[dict, dict] | None = None) -> list[tuple[str, int]]:
        """Longest piece from each place on; where none fits, the unknown token for one character."""
        start, inside = tries or self._pieces()
        mark = self.prefix if self.kind == "WordPiece" else ""
        out = []
        for word in _SPLIT.findall(text):
            if self.kind != "WordPiece":
                word = self.prefix + word
            at = 0
            while at < len(word):
                found, length = _longest(start if not at else inside, word, at)
                if length:
                    out.append((mark * (at > 0) + word[at : at + length], found))
                    at += length
                else:
                    out.append((self.unk_token, self.unk_id))
                    at += 1
        return out

    # -- columns

    def tokenize(self, text: Column | str, strategy: str = "auto") -> Column:
        """Array of (key, id) for a text column. Null and blank texts give an empty array. ``strategy``: "regex", "trie" or "auto", which is the trie."""
        column = F.col(text) if isinstance(text, str) else text
        return self._by_regex(column) if strategy == "regex" else self._by_trie(column)

    def pattern(self) -> str:
        """What matches the next piece at the start of a word or inside it, longest first, else any character."""
        line = lambda pieces: "|".join(re.escape(p) for p in sorted(pieces, key=lambda p: (-len(p), p)) if p)
        any_ = "(?s:.)"
        if self.kind != "WordPiece":
            return "|".join(filter(None, [line(self.vocab), any_]))
        inside = [t[len(self.prefix) :] for t in self.vocab if t.startswith(self.prefix)]
        first, more = line(self.vocab), line(inside)
        return "|".join(filter(None, [f"^(?:{first})" if first else "", f"(?!^)(?:{more})" if more else "", any_]))

    def _by_regex(self, text: Column) -> Column:
        pieces = lambda w: F.regexp_extract_all(w, F.lit(self.pattern()), F.lit(0))
        ids = F.create_map(*[F.lit(x) for t, i in self.vocab.items() for x in (t, i)]) if self.vocab else F.create_map().cast("map<string,int>")
        unk = F.struct(F.lit(self.unk_token).alias("key"), F.lit(self.unk_id).alias("id"))

        def token(p: Column, i: Column) -> Column:
            key = F.when(i > 0, F.concat(F.lit(self.prefix), p)).otherwise(p) if self.kind == "WordPiece" else p
            found = F.try_element_at(ids, key)
            return F.when(found.isNotNull(), F.struct(key.alias("key"), found.alias("id"))).otherwise(unk)

        word = (lambda w: w) if self.kind == "WordPiece" else (lambda w: F.concat(F.lit(self.prefix), w))
        return F.flatten(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.transform(pieces(word(w)), token)))

    def _by_trie(self, text: Column) -> Column:
        held = SparkSession.getActiveSession().sparkContext.broadcast(self.spec())  # the vocabulary, once per executor

        @F.arrow_udf(TOKENS)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            yield from pieces_of(held.value).tokens(batches)

        return run(text)

    def spec(self) -> str:
        return json.dumps([self.kind, self.prefix, self.unk_token, self.unk_id, self.vocab], ensure_ascii=False)


class Pieces:
    """A worker's tables: pieces of the words that it has met, as places in the vocabulary; the unknown token has the last place."""

    def __init__(self, spec: str):
        self.model = TokenizerModel(*json.loads(spec))
        self.tries = self.model._pieces()
        names = [*self.model.vocab, self.model.unk_token]
        self.keys, self.ids = pa.array(names, pa.string()), pa.array([*self.model.vocab.values(), self.model.unk_id], pa.int32())
        self.start, self.inside = replace(self.model, vocab={k: i for i, k in enumerate(self.model.vocab)})._pieces()  # tries of places
        self.unknown = len(self.model.vocab)
        self.mark = "" if self.model.kind == "WordPiece" else self.model.prefix
        self.words: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        """As :meth:`TokenizerModel.tokens`, in one loop: a corpus has many words that come once."""
        its, found, at, first = self.mark + word, array("i"), 0, self.start
        end = len(its)
        while at < end:
            node, place, i, at = first, self.unknown, at, at + 1
            while i < end and (node := node.get(its[i])) is not None:
                i += 1
                if "" in node:
                    place, at = node[""], i
            found.append(place)
            first = self.inside
        made = found.tobytes()
        if len(word) <= 64:
            if len(self.words) >= WORDS_KEPT:
                self.words.clear()
            self.words[word] = made
        return made

    def places(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary places of the tokens of each text, one after the other, and where each text's end, from 0 on."""
        known, made_of, ends = self.words, [], [0]
        for text in texts.to_pylist():
            made = b"".join([known.get(w) or self._word(w) for w in _SPLIT.findall(text)]) if text else b""
            made_of.append(made)
            ends.append(ends[-1] + len(made) // 4)
        return np.frombuffer(b"".join(made_of), np.int32), np.array(ends)

    def tokens(self, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """Lists of (key, id) for batches of texts, one part of a batch after the other."""
        for texts in parts(batches):
            at, ends = self.places(texts)
            tokens = pa.StructArray.from_arrays([self.keys.take(pa.array(at)), self.ids.take(pa.array(at))], names=["key", "id"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens)


def parts(batches: Iterator[pa.Array], most: int = PART_BYTES) -> Iterator[pa.Array]:
    """Batches of texts in slices of at most ``most`` bytes, or one text: tokens take many times the room of their text, and a batch may have 64 MB of it."""
    for texts in batches:
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            past = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield texts.slice(at, past - at)
            at = past
        if not len(texts):
            yield texts


def once(f):
    """Spark would run a function again for each filter on its result that it moves below it, such as the one that it adds before an explode."""
    return f.asNondeterministic()


@lru_cache(maxsize=4)
def pieces_of(spec: str) -> Pieces:
    return Pieces(spec)


def _trie(vocab: dict[str, int]) -> dict:
    root: dict = {}
    for token, id_ in vocab.items():
        node = root
        for c in token:
            node = node.setdefault(c, {})
        if token:
            node[""] = id_
    return root


def _longest(node: dict, word: str, at: int) -> tuple[int, int]:
    """Id and length of the longest piece at a place; length 0 if there is none."""
    found, length = -1, 0
    for i in range(at, len(word)):
        node = node.get(word[i])
        if node is None:
            break
        if "" in node:
            found, length = node[""], i + 1 - at
    return found, length


def explode_tokens(df: DataFrame, model: TokenizerModel, text: str = "text", strategy: str = "auto") -> DataFrame:
    """One row per token: the columns of ``df`` but the text, pos, key, id."""
    rest = [c for c in df.columns if c != text]
    made = df.select(*rest, F.posexplode(model.tokenize(text, strategy)).alias("pos", "_t"))
    return made.select(*rest, "pos", "_t.key", "_t.id")


def register_udtf(spark: SparkSession, name: str, model: TokenizerModel) -> None:
    """A table function ``name(text)`` with rows (pos, key, id), for SQL."""
    spec = model.spec()

    @F.udtf(returnType="pos int, key string, id int")
    class Tokenize:
        def eval(self, text: str):
            its = pieces_of(spec)
            for pos, (k, i) in enumerate(its.model.tokens(text or "", its.tries)):
                yield pos, k, i

    spark.udtf.register(name, Tokenize)
