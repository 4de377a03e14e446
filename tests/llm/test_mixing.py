"""Source mixing against a plain calculation."""

from __future__ import annotations

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import common, mixing


def plain_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, target, going = 1.5 * sum(sizes.values()), {}, list(names)
    while going:
        level = left / sum(weight[s] for s in going)
        over = [s for s in going if weight[s] * level >= 2 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in going}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            going.remove(s)
    return target


def check(rows, docs):
    assert len(rows) == len(docs)
    sizes, taken, most, target = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for row in rows:
        sizes[row["source"]] += row["size"]
        taken[row["source"]] += row["taken"]
        most[row["source"]] = max(most[row["source"]], row["size"])
        assert 0 <= row["taken"] <= 2 * row["size"]
        target[row["source"]] = row["target"]
    for source, value in plain_targets(sizes).items():
        assert target[source] == pytest.approx(value)
        assert abs(taken[source] - value) <= 1


def test_awkward_rows(awkward):
    rows = mixing.mix(awkward).collect()
    docs = awkward.collect()
    check(rows, docs)
    want = sorted(len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs)
    assert sorted(r["size"] for r in rows) == want


def test_hot_source_and_reruns(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('word ', int(1 + id % 37))").alias("text"),
        F.expr("if(id % 3 = 0, 'hot', concat('s', id % 11))").alias("source"))
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    check(mixing.mix(docs).collect(), docs.collect())
    assert first == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_documents_keep_columns_and_copies(awkward, wide):
    copies = {}
    for row in mixing.mix(awkward).collect():
        copies[row["doc_id"]] = copies.get(row["doc_id"], 0) + row["copies"]
    mixed = mixing.mixed_documents(wide)
    assert mixed.columns == wide.columns
    found = {}
    for row in mixed.collect():
        found[row["doc_id"]] = found.get(row["doc_id"], 0) + 1
    assert {k: v for k, v in copies.items() if v} == found


def test_nothing(nothing):
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_many_sources_and_rows_without_ids(spark, monkeypatch):
    """The way of more sources than a broadcast takes; a third of the rows share one hash, as their ids are null."""
    docs = spark.range(4000).select(
        F.expr("if(id % 3 = 0, NULL, id % 1500)").alias("doc_id"), F.expr("repeat('word ', int(1 + id % 41))").alias("text"),
        F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 101 = 1 THEN NULL ELSE concat('s', id % 57) END").alias("source"))
    want = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    check(mixing.mix(docs).collect(), docs.collect())
    assert sum(0 < row[6] % row[1] for row in want) <= 59  # at most one row of a source is taken in part
    for module in (mixing, common):
        monkeypatch.setattr(module, "SMALL_ROWS", 5)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str) == want
    whole = {}
    for row in want:
        whole[row[0], row[1]] = whole.get((row[0], row[1]), 0) + row[5]
    found = {}
    for row in mixing.mixed_documents(docs).filter("doc_id IS NOT NULL").collect():
        key = row["doc_id"], len(row["text"].split())
        found[key] = found.get(key, 0) + 1
    assert found == {k: v for k, v in whole.items() if v and k[0] is not None}


def test_ranges_sum_like_one_window(spark):
    rows = spark.range(500).selectExpr("id % 7 AS g", "id * 37 % 101 AS at", "id AS n")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        order = [F.col("g"), F.col("at"), F.col("n")]
        ranges = mixing._ranges(rows, order, "test-ranges")
        assert ranges.select("part").distinct().count() > 3
        got = mixing._before(ranges, ["g"], order, {"earlier_n": "n"}).select("g", "at", "n", "earlier_n")
        want = rows.selectExpr("*", "coalesce(sum(n) OVER (PARTITION BY g ORDER BY at, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier_n")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
