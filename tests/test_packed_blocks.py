"""Blocks of documents are packed, on disk and on the way, and lose nothing by it."""

from __future__ import annotations

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pendscope.operators import terms
from pendscope.session import shared_folder


def test_packing_keeps_numbers_and_texts():
    dice = random.Random(1)
    for n in (0, 1, 700):
        numbers = np.array([dice.choice((0, 1, 300, 70_000, 2**31 - 1)) for _ in range(n)], np.int64)
        assert terms._unpacked(terms._packed(numbers), n).tolist() == numbers.tolist()
        counts = np.array([dice.choice((1, 2**31, 2**52 + 1)) for _ in range(n)], np.int64)
        assert terms._unpacked_counts(terms._packed_counts(counts), n).tolist() == counts.tolist()
        texts = pa.array([dice.choice(("", "é", "two words", "日本")) for _ in range(n)], pa.string())
        rows = [{"n": n, **terms._packed_texts(texts)}, {"n": 1, **terms._packed_texts(pa.array(["last"]))}]
        assert terms._unpacked_texts(rows).to_pylist() == [*texts.to_pylist(), "last"]


def test_rising_codes_come_back():
    sizes = np.array([3, 0, 2, 0])
    starts = np.cumsum(sizes) - sizes
    codes = np.array([4, 9, 20, 1, 7])
    assert terms._risen(terms._steps(codes, starts), starts, sizes).tolist() == codes.tolist()


def test_weights_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(terms, "BLOCK_WORDS", 700)
    monkeypatch.setattr(terms, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(terms, "BATCH_ROWS", 7)
    dice = random.Random(2)
    docs = [(i, " ".join(dice.choices([f"w{j}" for j in range(60)] + ["été", "straße"], k=dice.randint(0, 40)))) for i in range(120)] + [(120, None), (121, "")]
    counts = {}
    for i, text in docs:
        words = (text or "").split()
        counts[i] = Counter(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    df = Counter(term for found in counts.values() for term in found)
    want = {}
    for i, found in counts.items():
        raw = {t: (1 + math.log(tf)) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t, tf in found.items() if df[t] >= 2}
        length = math.sqrt(sum(w * w for w in raw.values()))
        want |= {(i, t): w / length for t, w in raw.items()}
    got = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(spark.createDataFrame(docs, "id int, text string").repartition(3), "id", min_df=2).collect()}
    assert got == pytest.approx(want)


def test_a_stored_term_takes_few_bytes(spark):
    dice, folder = random.Random(3), shared_folder(spark)
    names = ["".join(dice.choices("abcdefghijklmnop", k=7)) for _ in range(3000)]
    docs = spark.createDataFrame([(i, " ".join(dice.choices(names, k=300))) for i in range(300)], "id int, text string").coalesce(1)
    before = set(os.listdir(folder))
    entries = terms.tfidf(docs, "id", min_df=1).count()
    new = [os.path.join(folder, name) for name in os.listdir(folder) if name not in before and name.startswith("terms-")]
    size = sum(os.path.getsize(os.path.join(at, name)) for top in new for at, _, found in os.walk(top) for name in found)
    assert entries > 150_000 and len(new) == 1
    assert size < 3.5 * entries  # rows of plain arrays took 3.9
