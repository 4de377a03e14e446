"""Links and classes against all pairs, on both ways of verifying."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import ngram_join as nj
from pendscope.llm import common
from pendscope.llm.components import components


def plain(rows):
    sets = [set(nj.gram_set(text).tolist()) for _, text in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(b)] = find(a)
    least = {}
    for k, (key, _) in enumerate(rows):
        least.setdefault(find(k), []).append(key)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return sorted(((key, least[find(k)], links[k]) for k, (key, _) in enumerate(rows)), key=str)


def copies(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def groups():
    rng = random.Random(11)
    rows = []
    for group, (size, length) in enumerate(((60, 150), (12, 100), (5, 40), (3, 400), (2, 12), (2, 7))):
        base = [f"g{group}w{rng.randrange(10 ** 4)}" for _ in range(length)]
        rows += [copies(rng, base, rng.randrange(0, max(1, length // 45) + 1)) for _ in range(size)]
        rows += [" ".join(base)] * (size // 2)
    rows += [" ".join(f"u{k}x{j}" for j in range(60)) for k in range(40)]
    rng.shuffle(rows)
    return [(k, text) for k, text in enumerate(rows)]


@pytest.mark.parametrize("dense,nodes", [(16, 1024), (2, 7), (1000, 1024)])
def test_all_pairs(spark, monkeypatch, groups, dense, nodes):
    monkeypatch.setattr(nj, "DENSE", dense)
    monkeypatch.setattr(nj, "BLOCK_NODES", nodes)
    got = nj.near_duplicates(spark.createDataFrame(groups, "doc_id bigint, text string"), recall=0.99999).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == plain(groups)


def test_awkward_rows(awkward, wide, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    got = nj.ngram_jaccard(wide).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == plain(rows)
    kept = nj.one_of_each(wide)
    assert kept.columns == wide.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, c, _ in plain(rows)})
    assert nj.ngram_jaccard(nothing).count() == 0 and nj.one_of_each(nothing).count() == 0


def test_banding_and_signature_recall():
    bands, rows = nj.banding(0.8, 0.999)
    assert bands * rows <= nj.HASHES and 1 - (1 - 0.8 ** rows) ** bands >= 0.999
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(300):
        shared = rng.integers(0, 2 ** 63, 400, dtype=np.uint64)
        sets = [np.unique(np.concatenate([shared, rng.integers(0, 2 ** 63, 50, dtype=np.uint64)])) for _ in range(2)]
        hits += bool((nj.band_hashes(sets[0], bands, rows) == nj.band_hashes(sets[1], bands, rows)).any())
    assert hits >= 297


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(900, k) for k in range(200, 260)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    root = {}

    def find(k):
        while root.setdefault(k, k) != k:
            k = root[k]
        return k

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: find(k) for k in root}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_hot_copies(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("if(id % 3 = 0, 'one two three four five six', concat('only ', id, ' words ', id * 7, ' here ', id))").alias("text"))
    rows = {r["doc_id"]: r for r in nj.ngram_jaccard(docs).collect()}
    assert rows[0]["n_links"] == 999 and rows[2997]["class_id"] == 0 and rows[1]["n_links"] == 0


def test_hubs_meet_by_broadcast(spark, monkeypatch):
    """The way of large tables, with few keys allowed: hot keys are broadcast, all others shuffled."""
    monkeypatch.setattr(common, "SMALL_ROWS", 3)
    test_components(spark)
    test_hot_copies(spark)
    rows = spark.createDataFrame([(k % 10 if k % 3 else 7, k) for k in range(300)] + [(None, 1)], "u bigint, v bigint")
    one = rows.groupBy("u").agg(F.max("v").alias("top"), F.count("*").alias("n"))
    want = sorted(map(tuple, rows.join(one.drop("n"), "u").collect()))
    assert sorted(map(tuple, common.meet(rows, one, "u", "n", 301).collect())) == want
    assert common.meet(rows.limit(0), one.limit(0), "u", "n", 0).count() == 0
