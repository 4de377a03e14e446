"""The cube answers like the claims do, for any scope, and after days have changed."""

from __future__ import annotations

import glob
import os
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import FIRST, LAST
from pendscope.operators import cube, journey, kpis, segments, themes, trends
from pendscope.operators.scope import Scope, scope

SCOPES = [Scope(), Scope(lob="alpha"), Scope(FIRST + timedelta(days=5), LAST - timedelta(days=20), platform="NORTH"), Scope(lob="none such")]


def plain(claims) -> dict:
    return {"kpis": kpis.kpis(claims), "themes": themes.theme_table(claims), "segments": segments.theme_segments(claims),
            "stages": journey.journey_stages(claims), "daily": trends.daily_overview(claims), "daily_themes": trends.daily_by_theme(claims)}


def same(rows, claims) -> None:
    for name, want in plain(claims).items():
        got = cube.overview_of(rows)[name]
        assert got.columns == want.columns
        assert got.collect() == want.collect(), name


@pytest.fixture(scope="module")
def path(claims, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("cube") / "c")
    cube.write_cube(claims, where)
    return where


@pytest.mark.parametrize("wanted", SCOPES)
def test_six_outputs(spark, claims, path, wanted):
    rows = cube.read_cube(spark, path)
    same(scope(cube.at(rows, cube.as_of(rows)), wanted), scope(claims, wanted))


def test_changed_days_write_their_months_alone(spark, claims, tmp_path):
    where = str(tmp_path / "c")
    cube.write_cube(claims, where)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{where}/month=*/*.parquet")}
    before = files()
    day = FIRST + timedelta(days=40)
    changed = claims.filter(~((F.col("received_date") == F.lit(day)) & F.expr("claim_id LIKE '%1'"))).withColumn(
        "touches", F.when(F.col("received_date") == F.lit(day), F.col("touches") + 5).otherwise(F.col("touches")))
    cube.update_cube(changed, where, [day])
    after = files()
    kept = f"month={day.replace(day=1)}"
    assert {f for f in before if kept not in f} == {f for f in after if kept not in f}
    assert all(before[f] == after[f] for f in before if kept not in f) and not set(before) & {f for f in after if kept in f}
    rows = cube.read_cube(spark, where)
    same(cube.at(rows, cube.as_of(rows)), changed)
    cube.update_cube(changed, where, [])
    assert files() == after


def test_later_reporting_day_needs_no_new_cube(spark, claims, path):
    """Open holds grow and unfinished claims become late without a claim of theirs changing."""
    rows = cube.read_cube(spark, path)
    later = cube.kpis_of(cube.at(rows, F.lit(LAST + timedelta(days=60)))).first()
    now = cube.kpis_of(cube.at(rows, cube.as_of(rows))).first()
    assert later["pend_days_total"] > now["pend_days_total"] and later["over_target"] >= now["over_target"]
    assert later["avg_days_pended"] == now["avg_days_pended"]


def test_rows_are_few_and_hold_no_text(spark, claims, path):
    rows = cube.read_cube(spark, path)
    assert cube.cube(claims.unionByName(claims)).count() == rows.count() <= claims.count()
    assert not {"claim_id", "adjuster_note", "provider_id"} & set(rows.columns)
    assert rows.agg(F.sum("claims")).first()[0] == claims.count()
    assert isinstance(rows.select("month").first()["month"], date)
