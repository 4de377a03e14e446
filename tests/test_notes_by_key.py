"""Orders meet their note by key and claims their cluster by digest: neither wide rows nor texts are moved for it."""

from __future__ import annotations

from collections import Counter

from pendscope.operators.cluster import Clusters, assign
from pendscope.sources.adapter import with_notes
from pendscope.sources.tables import SCHEMAS


def _plan(df) -> list[str]:
    return [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]


def test_notes_of_held_orders(spark, tmp_path):
    docs = [(0, "a\nb\nc", "en", "s", 5), (1, "one line", "en", "s", 8), (2, None, "en", "s", 0), (2, "twice\nhere", "en", "s", 10), (2, "twice\nagain", "en", "s", 11), (5, "", "en", "s", 0)]
    orders = [(k, 1, status, 1.0, None, "p") for k, status in [*((k, "P") for k in range(40)), (3, "O"), (7, "P"), (7, "P"), (50, "F"), (None, "P"), (None, "O")]]
    spark.createDataFrame(docs, SCHEMAS["documents"]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(orders, SCHEMAS["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    df = spark.read.parquet(f"{tmp_path}/orders.parquet").selectExpr("o_orderkey AS k", "o_orderstatus = 'P' AS held", "o_orderpriority AS wide")
    want: Counter = Counter()
    for k, _, status, *_ in orders:
        found = [text.split("\n") for doc, text, *_ in docs if status == "P" and k is not None and doc == k % len(docs) and text is not None]
        # a line is counted in each of the texts that share an id and looked up in all of them
        notes = [other[k // 7 % len(own)] if k // 7 % len(own) < len(other) else None for own in found for other in found]
        want.update((k, status == "P", note) for note in notes or [None])
    got = with_notes(df, spark, str(tmp_path))
    assert Counter((r["k"], r["held"], r["note"]) for r in got.collect()) == want
    assert "wide" in got.columns and "asked" in _plan(got)[0] and "doc_id" not in _plan(got)[0]


def test_clusters_are_matched_by_digest(spark):
    claims = spark.createDataFrame([("1", "t", "long text"), ("2", "t", None), ("3", "u", "long text"), ("4", "t", "long text"), ("5", "t", "new")], "claim_id string, theme string, adjuster_note string")
    members = spark.createDataFrame([("t", "long text", "t:1"), ("t", "", "t:2"), ("u", "long text", "u:1")], "theme string, note string, cluster_id string")
    found = assign(claims, Clusters(members, members, 0))
    assert {(r["claim_id"], r["cluster_id"]) for r in found.collect()} == {("1", "t:1"), ("2", "t:2"), ("3", "u:1"), ("4", "t:1")}
    assert "note_id" in _plan(found)[0]
