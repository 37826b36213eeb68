import array
import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillvec.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(PATH), Tokenizer.from_file(PATH)


def same(both, text):
    codec, library = both
    ids = list(array.array("i", codec.encode(text)))
    assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
    assert codec.decode(pa.array([ids], pa.list_(pa.int32()))).to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_encodes_and_decodes_as_the_library(both):
    for text in ["", "   ", "aaa aaaa aaaaaaaaa", "don't we'LL 's 'S", "x<|endoftext|>y <|startoftext|>", "<|endoftext", "Σας ΣΑΣ İstanbul ﬁ", "é é ́x", "a\x1cb\x85c\xa0d", "日本語テスト 한국어", "😀👍🏽!", "½ ² 123", "z" * 500 + "!" * 300]:
        same(both, text)


def test_every_latin_character(both):
    for c in map(chr, range(0x250)):
        same(both, f"q{c}q#{c}# '{c} {c.upper()}{c}")


def test_random_texts(both):
    random.seed(3)
    for letters in ["ab", "aeiou rst", "ñéèü ß'", "!?.,-*", " \t\nxyz019_", "日本語 かな", "lost the in ’Σ"]:
        for _ in range(150):
            same(both, "".join(random.choice(letters) for _ in range(random.randint(0, 60))))


def test_pieces_of_long_texts(both, monkeypatch):
    monkeypatch.setattr(bpe, "_PIECE", 5)
    random.seed(4)
    for _ in range(150):
        same(both, "".join(random.choice("日本 ab 's Σ  ") for _ in range(random.randint(0, 60))))


def test_full_stores_change_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "WORDS_KEPT", 4)
    monkeypatch.setattr(bpe, "ARCS_KEPT", 4)
    monkeypatch.setattr(bpe, "_LONG", 5)
    fresh = bpe.Codec(PATH), both[1]
    for _ in range(3):
        same(fresh, "the cat sat on the mat and the other cat sat on the other mat " * 3 + "日本語 antidisestablishmentarianism")


def test_texts_of_a_batch(both):
    random.seed(5)
    texts = ["".join(random.choice("abc est日é'1 \t!<|") for _ in range(random.randint(0, 40))) for _ in range(200)] + ["", "x<|endoftext|>y", "x" * 300]
    got = both[0].encode_all(texts)
    assert [list(array.array("i", g)) for g in got] == [both[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_automaton_against_plain_merging():
    random.seed(7)
    for _ in range(60):
        vocab = {c: i for i, c in enumerate("abc")}
        merges = []
        for _ in range(random.randint(1, 12)):
            a, b = random.choice(list(vocab)), random.choice(list(vocab))
            if a + b not in vocab:
                vocab[a + b] = len(vocab)
                merges.append((a, b))
        its = bpe.MergeAutomaton(vocab, merges, "")
        for _ in range(60):
            word = "".join(random.choice("abc") for _ in range(random.randint(1, 14)))
            parts = list(word)
            for a, b in merges:
                out, i = [], 0
                while i < len(parts):
                    if parts[i : i + 2] == [a, b]:
                        out.append(a + b)
                        i += 2
                    else:
                        out.append(parts[i])
                        i += 1
                parts = out
            assert its.encode(word) == [vocab[p] for p in parts], (merges, word)
            many, at = its.encode_many(["a", word, "", word])
            assert many.tolist() == [vocab["a"]] + 2 * [vocab[p] for p in parts] and at.tolist() == [0, 1, 1 + len(parts), 1 + len(parts), 1 + 2 * len(parts)]


def test_bad_ids_decode_to_nothing(both):
    lists = pa.array([[1, 2], None, [], [5, 99_999, -1, None, 49407]], pa.list_(pa.int32()))
    assert both[0].decode(lists).to_pylist() == ['" #', "", "", "& <|endoftext|>"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "the cat", 5), (1, "the cat", 5), (None, None, 6), (3, "", None)], "doc_id long, text string, ids int")
    got = bpe.encode(df, PATH, decoded="decoded").orderBy(F.col("doc_id").asc_nulls_first()).collect()
    assert [r.decoded for r in got] == ["", "the</w> cat</w>", "the</w> cat</w>", ""]
    assert [len(r.ids) for r in got] == [0, 2, 2, 0]
    assert bpe.decode(bpe.encode(df, PATH), PATH).count() == 4
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.encode(df, PATH, keep=["doc_id"]).columns == ["doc_id", "ids"]
