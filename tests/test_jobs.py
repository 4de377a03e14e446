"""Reading, writing, building and streaming."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import FIRST, LAST, SF_DIR
from pendscope.functions.text import doc_text_sql
from pendscope.operators.classify import fit_classifier
from pendscope.operators.scope import EmptyScope, Scope, scope
from pendscope.plans.build import build, current_build
from pendscope.sources.adapter import claims_from_orders
from pendscope.sources.claims import CLAIMS_SCHEMA, ENRICHED_SCHEMA, read_claims, write_claims
from pendscope.sources.tables import SCHEMAS, table
from pendscope.streaming.feed import daily_counts, enrich, enrich_stream


@pytest.mark.parametrize("kind", ["parquet", "csv"])
def test_claims_survive_a_round_trip(spark, claims, tmp_path, kind):
    stored = claims.select(*ENRICHED_SCHEMA.fieldNames(), "received_date")
    write_claims(stored, str(tmp_path / "c"), kind)
    again = read_claims(spark, str(tmp_path / "c"), kind).select(*stored.columns)
    assert again.exceptAll(stored).count() == 0 and stored.exceptAll(again).count() == 0


def test_a_day_scope_prunes_partitions(spark, claims, tmp_path):
    write_claims(claims.select(*ENRICHED_SCHEMA.fieldNames(), "received_date"), str(tmp_path / "c"))
    narrow = scope(read_claims(spark, str(tmp_path / "c")), Scope(FIRST, FIRST, platform="NORTH"))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_date" in plan and "EqualTo(platform,NORTH)" in plan
    assert len(narrow.inputFiles()) >= 1


def test_unknown_formats_are_refused(spark, claims, tmp_path):
    with pytest.raises(ValueError):
        read_claims(spark, str(tmp_path), "orc")
    with pytest.raises(ValueError):
        write_claims(claims, str(tmp_path), "orc")


def test_build_of_a_window(spark, tmp_path):
    claims = claims_from_orders(spark, SF_DIR)
    last = claims.agg(F.max("received_date")).first()[0]
    from datetime import timedelta

    first = last - timedelta(days=365)
    with pytest.raises(ValueError, match="63"):
        build(spark, claims, str(tmp_path), last - timedelta(days=20), last)
    with pytest.raises(EmptyScope):
        build(spark, claims, str(tmp_path), last + timedelta(days=1), last + timedelta(days=80))
    folder = build(spark, claims, str(tmp_path), first, last, restarts=1)
    assert current_build(spark, str(tmp_path)) == folder
    raw = read_claims(spark, f"{folder}/claims", enriched=False)
    enriched = read_claims(spark, f"{folder}/claims_enriched")
    assert raw.count() == enriched.count() == scope(claims, Scope(first, last)).count()
    assert set(CLAIMS_SCHEMA.fieldNames()) <= set(raw.columns)
    assert enriched.filter("pended <> (theme IS NOT NULL)").count() == 0
    assert enriched.filter("theme = 'needs_review' AND cluster_id IS NOT NULL").count() == 0
    window = spark.read.parquet(f"{folder}/report/window").first()
    assert window["as_of"] == last + timedelta(days=2)
    assert spark.read.parquet(f"{folder}/report/classifier_metrics").count() == 13
    assert spark.read.parquet(f"{folder}/report/confusion").count() == 169


def test_streamed_days_equal_the_batch(spark, tmp_path):
    events = table(spark, SF_DIR, "events")
    events.repartition(5).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(SCHEMAS["events"]).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    query = (daily_counts(feed, "ts", "event_type", lateness="60 days").writeStream.outputMode("complete").format("memory").queryName("days")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    assert query.awaitTermination(120)
    assert sorted(spark.table("days").collect()) == sorted(daily_counts(events, "ts", "event_type").collect())


def test_closed_days_leave_in_append_mode(spark, tmp_path):
    """Two days of lateness: a row inside them counts, one beyond them does not, and a day is written once, when it is closed."""
    def arrive(number, *days):
        rows = [(f"2026-01-{day:02d} 12:00:00", "a") for day in days]
        spark.createDataFrame(rows, "ts string, kind string").selectExpr("cast(ts AS timestamp) AS ts", "kind").coalesce(1).write.parquet(str(tmp_path / f"in/batch={number}"))

    written = []
    for number, days in enumerate(((1, 1, 2), (5, 6), (4, 1, 20), (21,))):
        arrive(number, *days)
        feed = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "in/*"))
        query = (daily_counts(feed, "ts", "kind").writeStream.outputMode("append").trigger(availableNow=True)
                 .option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda batch, _: written.extend(batch.collect())).start())
        assert query.awaitTermination(120)
    found = {row["day"]: row["n"] for row in written}
    assert len(found) == len(written)
    assert found == {"2026-01-01": 2, "2026-01-02": 1, "2026-01-04": 1, "2026-01-05": 1, "2026-01-06": 1}


def test_a_reader_during_a_swap_finds_a_complete_build(spark, tmp_path):
    from pendscope.plans.build import POINTER

    out = str(tmp_path)
    for number in (1, 3, 2):
        spark.createDataFrame([(f"build{number}", number)], POINTER).coalesce(1).write.mode("append").json(f"{out}/current")
        (tmp_path / "current" / "_draft").mkdir(exist_ok=True)  # a writer at work
        (tmp_path / "current" / "_draft" / "part-00000.json").write_text('{"folder":"half","built_at":9}')
        assert current_build(spark, out) == f"build{max(1, 3 if number > 1 else 1)}"


def test_arriving_claims_are_enriched_like_a_table(spark, claims, tmp_path):
    base = claims.select(*CLAIMS_SCHEMA.fieldNames())
    docs = claims.filter("pended").select("claim_id", "true_theme", F.expr(doc_text_sql()).alias("text"))
    model = fit_classifier(docs, "claim_id", "text", "true_theme")
    base.repartition(3).write.parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(CLAIMS_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    query = enrich_stream(feed, model, lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "cp"))
    assert query.awaitTermination(180)
    streamed = spark.read.parquet(out).select("claim_id", "theme", "confidence").collect()
    assert sorted(streamed, key=str) == sorted(enrich(base, model).select("claim_id", "theme", "confidence").collect(), key=str)
    assert LAST is not None
