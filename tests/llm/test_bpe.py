"""Ids and texts against the tokenizers library; the transducer against a dictionary."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import bpe, lexicon

TEXTS = ["", " ", "  a", "a  ", "\n\n a", "a　b c", "<|endoftext|>", "a<|endoftext|> b <|endoftext|><|endoftext|>", "it's we'll I'D 'S don't", "x" * 300 + "yz" * 200,
         "日本語テキスト 한국어", "\x00\x1c\x1f \x7f", "²³¼ ½", "emoji 😀😀 👩‍👩‍👧", "aaa aaaa aaaaaaa", "\t\t\tx", "\r\n\r\n  \r\n", "___ _a_ 1_2", "Ⅳ ⅷ x١٢٣", "̀ͅá",
         "՘֋ x", "a" * 70 + " " + "ab" * 50, "the the the", "Ünïcödé naïve ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def codec(tmp_path, words):
    (tmp_path / "lexicon").write_bytes(bpe.compiled(words, bpe.tokenizer_path()))
    return bpe.Codec(lexicon.mapped(str(tmp_path / "lexicon")))


@pytest.mark.parametrize("words", [[], [" the", "the", " naïve", "aaa", " ", "tokenization", " tokens"]])
def test_same_ids(tmp_path, library, words):
    mine = codec(tmp_path, words)
    for text, ids in zip(TEXTS, mine.encode(TEXTS)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want, text
        assert mine.decode(ids).decode() == library.decode(want, skip_special_tokens=False)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(1, 0x500), rng.randrange(0x2000, 0x3100), 32))) for _ in range(60))
        assert mine.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, text
    ids = [rng.randrange(50257) for _ in range(300)]
    assert mine.decode(np.array(ids)).decode() == library.decode(ids, skip_special_tokens=False)


def test_plain_characters_split_alike(library):
    """Every character that takes the short way is classed as the tokenizer classes it."""
    def kind(split, c):
        return next((k for k in "a1!" if len(split(k + c)) == 1), " ")

    plain = [chr(k) for k in range(0x2400) if bpe._PLAIN.fullmatch(chr(k))]
    assert len(plain) > 900
    for c in plain:
        assert kind(bpe._WORD.findall, c) == kind(library.pre_tokenizer.pre_tokenize_str, c), hex(ord(c))


def test_transducer():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 9))) for _ in range(2000)})
    sizes = np.array([k % 4 for k in range(len(words))])
    arrays = lexicon.build(words, np.arange(sizes.sum()), sizes)
    assert lexicon.lookup(arrays, words).tolist() == list(range(len(words)))
    others = [w for w in (bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 11))) for _ in range(2000)) if w not in set(words)]
    assert (lexicon.lookup(arrays, others) == -1).all()
    assert len(arrays["final"]) < len({w[:k] for w in words for k in range(len(w) + 1)})  # suffixes are shared
    assert lexicon.lookup(lexicon.build([], np.array([]), np.array([], int)), [b"a"]).tolist() == [-1]


def test_query(spark, library, awkward, wide, nothing):
    want = []
    for row in awkward.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        want.append((row["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, bpe.encode_digests(awkward).collect()), key=str) == sorted(want, key=str)
    back = bpe.decode(bpe.encode(awkward.select("text"), into="ids"), into="again").collect()
    assert all(r["again"] == (r["text"] or "") for r in back)
    assert bpe.encode(wide).columns == wide.columns
    assert bpe.encode_digests(nothing).count() == 0


def test_frequent_words(spark):
    docs = spark.createDataFrame([("b a a c" + " a" * 50 + " d" * 9,), (None,)], "text string")
    assert bpe.frequent_words(docs, words=2) == [" a", " d"] or set(bpe.frequent_words(docs, words=2)) == {" a", " d"}
    assert re.match(" ?a", bpe.frequent_words(docs, words=1)[0])
