"""Thresholds are tried where no token lies too."""

from __future__ import annotations

from pendscope.llm import secrets as s


def least(rows, spark):
    tokens = spark.createDataFrame([("base32", 4, p) for p in rows], "code string, length_class int, p double")
    return [r["at_least"] for r in s.thresholds(tokens).collect()]


def test_lone_secret(spark):
    for p in (0.1, 0.5, 0.8, 0.95, 1.0):
        found = least([0.0] * 500 + [p], spark)
        assert len(found) == 1 and found[0] <= p, (p, found)
    assert least([0.0] * 500, spark) == []


def test_lowest_threshold(spark):
    rows = [0.0] * 300 + [k / 97 for k in range(97)] + [0.031] * 40 + [0.27] * 9
    bins = [min(int(p * s.BINS), s.BINS - 1) for p in rows]
    random = 2 * (sum(2 * b >= s.BINS for b in bins) + 1)
    want = next(t for t in range(1, s.BINS) if (n := sum(b >= t for b in bins)) and 1 - (1 - t / s.BINS) * random / n <= s.FALSE_SHARE)
    assert least(rows, spark) == [want / s.BINS]
