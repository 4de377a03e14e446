"""An update of a build writes the changed days and nothing else."""

from __future__ import annotations

import glob
import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import FIRST, LAST
from pendscope.plans.build import build, current_build, day_digests, update_build
from pendscope.sources.claims import CLAIMS_SCHEMA, read_claims

RAW = (*CLAIMS_SCHEMA.fieldNames(), "received_date")


@pytest.fixture(scope="module")
def built(spark, claims, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("updated"))
    build(spark, claims, out, FIRST, LAST, restarts=1)
    return out


def _files(folder: str) -> dict:
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/claims*/received_date=*/*.parquet")}


def _rows(spark, folder: str, enriched: bool = False) -> dict:
    return {r["claim_id"]: r.asDict() for r in read_claims(spark, f"{folder}/{'claims_enriched' if enriched else 'claims'}", enriched=enriched).collect()}


def test_update(spark, claims, built):
    folder = current_build(spark, built)
    assert update_build(spark, claims, built) == []
    before, enriched = _files(folder), _rows(spark, folder, True)
    day, gone = LAST - timedelta(days=3), FIRST + timedelta(days=20)
    known = next(r for r in enriched.values() if r["cluster_id"] and r["received_date"] != gone)
    on_day = F.col("received_date") == F.lit(day)
    changed = claims.select(*RAW).filter(F.col("received_date") != F.lit(gone)).withColumns({
        "touches": F.when(on_day, F.lit(99)).otherwise(F.col("touches")),
        "adjuster_note": F.when(on_day & F.col("pended"), F.lit(known["adjuster_note"])).otherwise(F.col("adjuster_note"))})
    assert update_build(spark, changed, built) == [gone, day]
    assert current_build(spark, built) == folder
    after = _files(folder)
    touched = [f"received_date={d}/" for d in (day, gone)]
    outside = {f: t for f, t in before.items() if not any(part in f for part in touched)}
    assert outside == {f: t for f, t in after.items() if not any(part in f for part in touched)}
    assert not any(str(gone) in f for f in after) and not set(before) & {f for f in after if f"received_date={day}/" in f}
    raw = {r["claim_id"]: r.asDict() for r in changed.collect()}
    assert {i: {n: r[n] for n in RAW} for i, r in _rows(spark, folder).items()} == raw
    now = _rows(spark, folder, True)
    assert now.keys() == raw.keys()
    for claim, row in now.items():
        if row["received_date"] != day:
            assert row == enriched[claim]
        elif row["pended"]:
            assert row["theme"] is not None and row["touches"] == 99
            assert (row["cluster_id"] == known["cluster_id"]) == (row["theme"] == known["theme"])
    assert update_build(spark, changed, built) == []


def test_an_update_that_broke_off_is_found_again(spark, claims, built, monkeypatch):
    from pendscope.plans import build as module

    day = FIRST + timedelta(days=30)
    folder = current_build(spark, built)
    state = _rows(spark, folder)
    changed = claims.select(*RAW).filter(F.col("claim_id").isin(list(state))).withColumn(
        "status", F.when(F.col("received_date") == F.lit(day), F.lit("Other")).otherwise(F.col("status")))
    monkeypatch.setattr(module, "_point_to", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
    monkeypatch.setattr(module, "enrich_claims", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        update_build(spark, changed, built)
    monkeypatch.undo()
    assert day in update_build(spark, changed, built)
    assert all(r["status"] == "Other" for r in _rows(spark, folder, True).values() if r["received_date"] == day)


def test_digests_hang_on_every_column_and_not_on_order(spark, claims):
    raw = claims.select(*RAW)
    base = {r["received_date"]: r["digest"] for r in day_digests(raw).collect()}
    assert base == {r["received_date"]: r["digest"] for r in day_digests(raw.repartition(7, "claim_id")).collect()}
    for column, value in {"denial_code": F.lit("x"), "touches": F.lit(7), "released_ts": F.col("received_ts")}.items():
        other = {r["received_date"]: r["digest"] for r in day_digests(raw.withColumn(column, value)).collect()}
        assert all(base[d] != other[d] for d in base)
