"""Hard negatives: scans with bounds against plain scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pendscope.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows) -> set[tuple]:
    sound = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows
             if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for anchor, label, v in sound:
        if anchor % 50:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        ranked = sorted((-score(w), i, other) for i, other, w in sound if i != anchor)
        for p, positive, _ in [r for r in ranked if r[2] == label][:5]:
            fitting = [r for r in ranked if r[2] != label and 50 * -p <= 100 * -r[0] <= 95 * -p]
            out |= {(anchor, positive, rank, r[1], -p, -r[0]) for rank, r in enumerate(fitting[:3], 1)}
    return out


def found(spark, rows) -> set[tuple]:
    columns = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    got = [tuple(r[c] for c in columns) for r in hn.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got))
    return set(got)


def points(count: int, dims: int, seed: int = 1) -> list[tuple]:
    dice = random.Random(seed)
    middles = [[dice.gauss(0, 0.3) for _ in range(dims)] for _ in range(4)]
    return [(i, [m + dice.gauss(0, 0.2) for m in middles[i % 4]], i % 4) for i in range(count)]


def test_against_plain_scores(spark, monkeypatch):
    rows = points(700, 40)
    want = plain(rows)
    assert len(want) > 100
    assert found(spark, rows) == want
    # many small blocks on both sides
    for name, value in {"ROWS_LEAST": 60, "ANCHORS_LEAST": 3, "STRETCH": 7}.items():
        monkeypatch.setattr(hn, name, value)
    assert found(spark, rows) == want


def test_awkward_rows(spark):
    rows = points(120, 20, seed=2)
    rows += [(1000, None, 1), (1001, [0.1] * 20, None), (1002, [float("nan")] * 20, 1), (1003, [float("inf")] + [0.0] * 19, 1),
             (1004, [None] * 20, 2), (1005, [], 3), (1006, [0.5] * 3, 1), (None, [0.1] * 20, 1)]
    assert found(spark, rows) == plain(rows)
    # copies of a row change nothing, however many
    assert found(spark, rows + [rows[3]] * 40 + [rows[50]] * 3) == plain(rows)


def test_ties_and_negative_scores(spark):
    rows = [(i, [float(i % 3 - 1), 0.25], i % 2) for i in range(160)]
    assert found(spark, rows) == plain(rows)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(v[0] * 2**19), float(v[1] * 2**18), 1.0], label) for i, v, label in points(200, 2, seed=5)]
    assert found(spark, rows) == plain(rows)
    with pytest.raises(ValueError):
        found(spark, [(0, [3e30], 1), (1, [3e30], 1)])


def test_nothing_to_find(spark):
    assert found(spark, []) == set()
    assert found(spark, [(0, [1.0], 1)]) == set()
    assert found(spark, [(i, [1.0], 1) for i in range(1, 40)]) == set()
    wide = spark.createDataFrame(points(60, 4), SCHEMA).select("*", *(F.lit("x").alias(c) for c in ("v", "row_block", "anchor_block", "rank", "anchor_id")))
    assert hn.hard_negatives(wide).count() == len(plain(points(60, 4)))


def test_bounds_leave_few_rows(spark):
    """Dimensions that matter less and less: the scan must rule rows out before it has read them all."""
    import pyarrow as pa

    rows = [(i, [x / (1 + at) for at, x in enumerate(v)], label) for i, v, label in points(2000, 64, seed=7)]
    vectors = np.floor(256 * np.float32([v for _, v, _ in rows])).astype(float)
    table = pa.table({"vec_id": [r[0] for r in rows], "label": [r[2] for r in rows], "v": vectors.tolist()})
    block = hn.Block(table, hn.Grid(1, 1, 64, False))
    left = []

    def keep(partial, low, high):
        kept = partial + high >= hn._reach(partial, 5) + low
        left.append(kept.sum() / len(rows))
        return kept

    block.scan(vectors[0], np.arange(len(rows)), block.ends, keep)
    assert left == sorted(left, reverse=True) and left[0] < 0.5 and left[1] < 0.1
