"""Search by index finds what the scan finds, and reads few files for it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pendscope.operators.browse import find_claims
from pendscope.operators.search_index import files_without, find_indexed, index_files, read_index, search_report, write_searchable


@pytest.fixture(scope="module")
def searched(spark, claims, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("search"))
    noted = claims.withColumn("adjuster_note", F.when(F.col("claim_id") == "C2600000007", "Straße ÄÖ 100% (x) zebra " + "a" * 5000).otherwise(F.col("adjuster_note")))
    write_searchable(noted, f"{folder}/claims", file_rows=20)
    stored = spark.read.schema(noted.schema).parquet(f"{folder}/claims")
    index_files(stored).write.parquet(f"{folder}/index")
    return folder, stored, read_index(spark, f"{folder}/index")


@pytest.mark.parametrize("query", [" Zebra ", "straße äö", "note 3 ON", "C2600000007", "c26", "p3", "x", "", "  ", "100% (x", "100% of .*", "nowhere at all", "aaaa"])
def test_same_rows_as_the_scan(searched, query):
    _, stored, index = searched
    assert sorted(r["claim_id"] for r in find_indexed(stored, index, query).collect()) == sorted(r["claim_id"] for r in find_claims(stored, query=query.strip()).collect())


def test_left_out_files_hold_nothing(searched):
    _, stored, index = searched
    report = search_report(stored, index, "zebra").first()
    assert report["files"] > 5 and report["files_read"] == 1 and report["share_read"] == 1 / report["files"]
    assert search_report(stored, index, "nowhere at all").first()["files_read"] <= 1
    assert search_report(stored, index, "ze").first()["share_read"] == 1.0
    plan = find_indexed(stored, index, "zebra").select(F.col("_metadata.file_path")).distinct()
    assert plan.count() <= 1 and files_without(index, "zebra").count() == report["files"] - 1


def test_new_files_are_read_and_then_indexed(spark, searched, claims, tmp_path):
    folder, stored, index = searched
    stored.write.parquet(f"{tmp_path}/claims")
    spark.read.schema(stored.schema).parquet(f"{tmp_path}/claims").limit(0).count()
    grown = spark.read.schema(stored.schema).parquet(f"{folder}/claims", f"{tmp_path}/claims")
    assert find_indexed(grown, index, "zebra").count() == 2 * find_indexed(stored, index, "zebra").count()
    added = index_files(grown, index)
    assert added.join(index, "file").count() == 0
    whole = index.unionByName(added)
    assert search_report(grown, whole, "zebra").first()["files_read"] == 2
    assert index_files(grown, whole).count() == 0


def test_empty_table_and_empty_texts(spark, claims, tmp_path):
    blank = claims.limit(3).withColumns({name: F.lit(None).cast("string") for name in ("adjuster_note", "provider_id", "claim_id")})
    blank.write.parquet(f"{tmp_path}/blank")
    stored = spark.read.schema(blank.schema).parquet(f"{tmp_path}/blank")
    index = index_files(stored)
    assert index.count() == 0 and find_indexed(stored, index, "note").count() == 0
    claims.limit(0).write.parquet(f"{tmp_path}/none")
    none = spark.read.schema(claims.schema).parquet(f"{tmp_path}/none")
    assert find_indexed(none, index_files(none), "note").count() == 0 and search_report(none, index_files(none), "note").first()["files"] == 0


def test_long_and_short_texts_have_the_same_pieces(spark, tmp_path):
    from pendscope.operators import search_index

    text = "Straße ÄÖ 😀 zebra " * 3
    rows = [(f"K{i}", text[:n], None) for i, n in enumerate((0, 2, 3, 40, 57))]
    spark.createDataFrame(rows, "claim_id string, adjuster_note string, provider_id string").coalesce(1).write.parquet(f"{tmp_path}/c")
    stored, keep, found = spark.read.parquet(f"{tmp_path}/c"), search_index.SHORT, []
    for search_index.SHORT in (64, 2):
        found.append(sorted((r["part"], bytes(r["bits"])) for r in index_files(stored).collect()))
    search_index.SHORT = keep
    assert found[0] == found[1] and found[0]
