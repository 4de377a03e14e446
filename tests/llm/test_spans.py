"""Positions of matches against Python's own, for any number of matches, in time that does not grow with their square."""

from __future__ import annotations

import random
import re
import time

import pytest

from pendscope.llm.spans import matches

PATTERNS = [(r"[0-9a-f]{6,}", 0), (r"(key|id) *= *([a-z0-9]+)", 2), ("x", 0)]


@pytest.mark.parametrize("pattern, group", PATTERNS)
def test_against_python(spark, pattern, group):
    dice = random.Random(8)
    words = ["deadbeef", "0123456789", "key = abc1", "id=9", "ü", "😀", "x", "\n", "none", "日本"]
    texts = [" ".join(dice.choices(words, k=k)) for k in (0, 1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 50, 99, 100, 101, 700)] + ["xxxxxxxx", "", "x"]
    frame = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", matches("text", pattern, group).alias("m"))
    for row in frame.collect():
        want = [(m.start(), m.end(), m[0], m[group]) for m in re.finditer(pattern, texts[row["k"]])]
        assert [tuple(m) for m in row["m"]] == want


def test_many_matches_in_one_text(spark):
    took = {}
    for count in (5_000, 40_000):
        frame = spark.createDataFrame([(" ".join(f"{k:08x}" for k in range(count)),)], "text string").select(matches("text", PATTERNS[0][0]).alias("m"))
        began = time.time()
        last = frame.selectExpr("size(m) AS n", "m[size(m) - 1].stop AS stop").first()
        took[count] = time.time() - began
        assert (last["n"], last["stop"]) == (count, 9 * count - 1)
    assert took[40_000] < 40 * max(took[5_000], 0.5)
