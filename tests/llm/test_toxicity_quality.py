"""Held-out recall and ranking on the larger table, places in the text as it is, and models that do not mix."""

from __future__ import annotations

import os

import numpy as np
import pytest

from pendscope.llm import toxicity as tox
from pendscope.llm.common import table


def area(scores: np.ndarray, labels: np.ndarray) -> float:
    """Share of (toxic, clean) pairs in the right order, ties counting half."""
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    ranks[order] = np.arange(1, len(scores) + 1)
    for value in np.unique(scores):
        ranks[scores == value] = ranks[scores == value].mean()
    toxic = labels == 1
    return (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())


@pytest.fixture(scope="module")
def held_out(spark):
    sf_dir = os.environ.get("TEST_TOXIC_DIR", "/root/testdata/sf0.1")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = tox.toxicity(docs, labels).filter("held_out").join(labels.filter("toxic IS NOT NULL"), "doc_id").collect()
    return np.array([r["score"] for r in rows]), np.array([r["toxic"] for r in rows])


def test_recall_precision_and_ranking(held_out):
    scores, labels = held_out
    guessed = scores >= tox.THRESHOLD
    recall, precision = guessed[labels == 1].mean(), labels[guessed].mean()
    print(f"recall {recall:.3f}, precision {precision:.3f}, area {area(scores, labels):.3f}, toxic {labels.sum()} of {len(labels)}")
    assert area(scores, labels) > 0.9 and recall > 0.7 and precision > 0.8


def test_places_of_the_text_itself(spark):
    texts = ["plain words here iii ßß ας i", "nastyword here"] * 60
    model = tox.fit(texts, [0, 1] * 60)
    rows = tox.score_toxicity(spark.createDataFrame([("İİİ nastyword ẞß ΑΣ nastyword",), ("NASTYWORD İ",)], "text string"), model).collect()
    for row, count in zip(rows, (2, 1)):
        found = [row["text"][int(a):int(b)] for a, b in (span.split(":") for span in row["spans"].split(","))]
        assert [w.lower() for w in found] == ["nastyword"] * count


def test_models_in_turn(spark):
    docs = spark.createDataFrame([("first second",)], "text string").coalesce(1)
    one, two = (tox.fit([f"{w} word", "other word"] * 60, [1, 0] * 60) for w in ("first", "second"))
    for _ in range(3):
        spans = [tox.score_toxicity(docs, model).first()["spans"] for model in (one, two)]
        assert spans == ["0:5", "6:12"]
    assert one.digest() != two.digest() and one.digest() == tox.fit(["first word", "other word"] * 60, [1, 0] * 60).digest()
