"""Connected components by alternating stars: shuffles of edges only, a few rounds, no group gathered anywhere.

A hub has any number of neighbours, so its rows are never dealt by its name (``common.meet``): the few nodes of most neighbours are
broadcast with their least one. Least neighbours and distinct edges are combined inside the tasks before a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.llm.common import meet, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def with_least(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (u, v and others) with m, the least v of their u. ``n_rows``: a bound on their number."""
    return meet(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", "n", n_rows)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint); root is the least node of its component.

    A round joins each node's larger neighbours to its least neighbour, then its smaller neighbours and itself to the
    least of those, until nothing changes. Loops and repeated edges do no harm; no edges give no rows."""
    edges = stored(edges.filter("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.selectExpr("v AS u", "u AS v"))
        large = with_least(both, 2 * before[0]).withColumn("m", F.expr("least(u, m)"))
        large = stored(large.filter("v > u AND v <> m").selectExpr("v AS u", "m AS v").distinct(), "edges-large")
        small = with_least(large, before[0]).selectExpr("if(v = m, u, v) AS u", "m AS v")
        edges = stored(small.distinct(), "edges")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.selectExpr("u AS node", "v AS root").unionByName(edges.selectExpr("v AS node", "v AS root").distinct())
