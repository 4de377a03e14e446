"""The field against enumeration of all state sequences, and held-out accuracy."""

from __future__ import annotations

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import toxicity as tox
from pendscope.llm.common import table


def test_marginals_by_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([0, 5, 1, 7, 5, 0, 2])
    ratio, step = np.exp(rng.normal(size=sizes.sum())), np.exp(rng.normal(size=(2, 2)))
    got = tox.marginals(*tox.passes(ratio, sizes, step))
    want = []
    for part in np.split(ratio, np.cumsum(sizes)[:-1]):
        total, toxic = 0.0, np.zeros(len(part))
        for states in itertools.product((0, 1), repeat=len(part)):
            weight = np.prod([part[k] if s else 1.0 for k, s in enumerate(states)])
            weight *= np.prod([step[a, b] for a, b in zip((0, *states), states)]) if len(part) else 1.0
            total += weight
            toxic += weight * np.array(states, float)
        want += list(toxic / total)
    assert np.allclose(got, want)


def made(n, seed):
    rng = np.random.default_rng(seed)
    plain, bad = [f"plain{k}" for k in range(300)], ["nastyword", "foulmouth", "spitefulx"]
    texts, labels = [], []
    for k in range(n):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        if label := int(k % 5 == 0):
            words += [str(w) + str(rng.integers(0, 50)) for w in rng.choice(bad, 3)]
            rng.shuffle(words)
        texts.append(" ".join(words))
        labels.append(label)
    return texts, labels


def test_unseen_documents_and_spans(spark, awkward, wide, nothing):
    texts, labels = made(600, 1)
    model = tox.fit(texts, labels)
    texts, labels = made(300, 2)
    docs = spark.createDataFrame(list(zip(range(300), texts, labels)), "doc_id bigint, text string, toxic int")
    rows = tox.score_toxicity(docs, model).collect()
    assert sum((r["score"] >= tox.THRESHOLD) == r["toxic"] for r in rows) >= 295
    for r in rows:
        for span in filter(None, r["spans"].split(",")):
            a, b = map(int, span.split(":"))
            assert r["text"][a:b].startswith(("nasty", "foul", "spite"))
    empty = tox.score_toxicity(awkward, model).filter("coalesce(trim(text), '') = ''").collect()
    assert all(r["score"] < tox.THRESHOLD for r in empty)
    assert tox.score_toxicity(wide, model).count() == wide.count()
    assert tox.score_toxicity(nothing, model).count() == 0


@pytest.mark.parametrize("labels,score", [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_one_label_only(labels, score):
    model = tox.fit(["some words"] * len(labels), labels)
    assert tox.Scorer(model)(["other words", None])[0].round(6).tolist() == [score, score]


def test_held_out_accuracy(spark):
    sf_dir = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.01")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = tox.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert rows and all(0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.93
    assert not tox.toxicity(docs, labels).filter(F.crc32(F.col("doc_id").cast("string")) % 4 == 2).filter("NOT held_out").count()
