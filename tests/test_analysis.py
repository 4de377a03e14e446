"""The analysis operators on the hand-made claims, checked by plain Python."""

from __future__ import annotations

import random
import statistics
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DAYS, FIRST, LAST, QUIET_DAY, RISE_FROM
from pendscope.config import check_window
from pendscope.functions.columns import nearest_sql, rounded
from pendscope.functions.exact_median import exact_quantile
from pendscope.operators import browse, emerging, findings, interventions, journey, kpis, segments, themes, trends
from pendscope.operators.scope import EmptyScope, Scope, require_rows, scope
from pendscope.plans.reconcile import reconcile


def held_days(row) -> float:
    until = row["released_ts"] or (LAST + timedelta(days=2))
    if not hasattr(until, "hour"):
        from datetime import datetime

        until = datetime(until.year, until.month, until.day)
    return (until - row["pended_ts"]).total_seconds() / 86400


def test_rounding_equals_python(spark):
    random.seed(3)
    values = [random.randrange(10**6) * 5 / 10**3 for _ in range(500)] + [random.randrange(10**8) / 86400 for _ in range(500)] + [8.245, 2.5, -0.15, 0.125]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 4):
        for row in df.select("x", rounded("x", digits).alias("a"), F.expr(nearest_sql("x", digits)).alias("b")).collect():
            assert row["a"] == round(row["x"], digits) and row["b"] == row["a"]


def test_exact_quantile_matches_sorting_with_a_hot_value(spark):
    random.seed(5)
    data = [(random.choice("abc"), random.choice([7200, random.randrange(0, 900_000)])) for _ in range(3000)]
    for q in (0.5, 0.95, 0.0, 1.0):
        got = {r["k"]: r["quantile"] for r in exact_quantile(spark.createDataFrame(data, "k string, v long"), "k", "v", q).collect()}
        for key in "abc":
            values = sorted(v for k, v in data if k == key)
            at = q * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert got[key] == pytest.approx(low + (high - low) * (at - int(at)), abs=1e-6)


def test_kpis(claims, rows):
    row = kpis.kpis(claims).first()
    held = [r for r in rows if r["pended"]]
    assert (row["claims"], row["pended"], row["open_pended"]) == (len(rows), len(held), 1)
    assert row["pended_rate"] == round(len(held) / len(rows), 4)
    assert row["avg_pend_days"] == round(sum(map(held_days, held)) / len(held), 1)
    assert row["manual_touches"] == 2 * len(held)


def test_kpis_of_nothing(claims):
    row = kpis.kpis(claims.filter("false")).first()
    assert row["claims"] == 0 and row["pended_rate"] is None and row["avg_days_clean"] is None and row["pend_days_total"] == 0


def test_theme_table(claims, rows):
    table = themes.theme_table(claims).collect()
    assert [r["pend_days"] for r in table] == sorted((r["pend_days"] for r in table), reverse=True)
    for row in table:
        mine = [held_days(r) for r in rows if r["theme"] == row["key"]]
        assert row["claims"] == len(mine)
        assert row["median_pend_days"] == round(statistics.median(mine), 1)
        assert row["pend_days"] == round(sum(mine))
    review = next(r for r in table if r["key"] == "needs_review")
    assert review["stage"] is None and review["name"]


def test_ranking_falls_back_to_days(claims):
    assert [r["key"] for r in themes.rank_themes(claims, "nonsense").collect()] == [r["key"] for r in themes.rank_themes(claims).collect()]
    by_claims = [r["claims"] for r in themes.rank_themes(claims, "claims").collect()]
    assert by_claims == sorted(by_claims, reverse=True)


def test_every_day_is_present(claims):
    days = trends.daily_overview(claims).collect()
    assert len(days) == DAYS and days[0]["day"] == FIRST.isoformat() and days[-1]["day"] == LAST.isoformat()
    quiet = next(d for d in days if d["day"] == QUIET_DAY.isoformat())
    assert quiet["received"] == 0 and quiet["pended_rate"] is None


def test_series_cover_all_keys_and_days(claims):
    by_theme = trends.daily_by_theme(claims)
    sums = {r["key"]: (r["n"], r["days"]) for r in by_theme.groupBy("key").agg(F.sum("pended").alias("n"), F.count("*").alias("days")).collect()}
    assert all(days == DAYS for _, days in sums.values())
    assert {r["key"]: r["claims"] for r in themes.theme_table(claims).collect()} == {k: n for k, (n, _) in sums.items()}
    assert trends.daily_by_stage(claims).count() == 4 * DAYS


def test_outputs_reconcile(claims):
    checks = reconcile(claims).collect()
    assert len(checks) == 6 and all(c["passed"] for c in checks)


def test_rise_is_found_with_driver_and_onset(claims):
    found = emerging.emerging(claims).collect()
    assert [r["key"] for r in found] == ["provider_match"]
    row = found[0]
    assert (row["driver_dimension"], row["driver_value"]) == ("platform", "NORTH")
    assert row["onset"] == RISE_FROM.isoformat() and row["share_text"] == "nearly all"
    assert (row["recent_from"], row["recent_to"]) == (RISE_FROM.isoformat(), LAST.isoformat())
    assert row["base_to"] == (RISE_FROM - timedelta(days=1)).isoformat()


def test_themes_without_baseline_are_left_out(claims):
    scores = {r["theme"] for r in emerging.rise_scores(claims).collect()}
    assert "provider_match" in scores and "pricing" not in scores and "cob" not in scores


def test_a_flat_baseline_never_rises(claims):
    daily = claims.filter("NOT pended").dropDuplicates(["received_date"])
    daily = daily.unionByName(daily.limit(1).withColumn("received_date", F.lit(QUIET_DAY)))
    flat = daily.withColumns({"pended": F.lit(True), "theme": F.lit("duplicate")})
    row = emerging.rise_scores(flat).first()
    assert row["base_sum"] == 42 and row["z"] == 0 and emerging.emerging(flat).count() == 0


def test_scope_below_63_days_is_not_checked(claims):
    short = scope(claims, Scope(date_from=LAST - timedelta(days=61)))
    exact = scope(claims, Scope(date_from=LAST - timedelta(days=62)))
    assert emerging.emerging(short).count() == 0 and not emerging.emerging_status(short).first()["checked"]
    assert emerging.emerging(exact).count() == 1 and emerging.emerging_status(exact).first()["checked"]


def test_filters_narrow_and_an_empty_scope_is_an_error(claims, rows):
    alpha = scope(claims, Scope(lob="alpha"))
    assert alpha.count() == sum(r["lob"] == "alpha" for r in rows)
    one_day = scope(claims, Scope(FIRST, FIRST))
    assert one_day.count() == sum(r["received_ts"].date() == FIRST for r in rows)
    assert require_rows(alpha) is alpha
    with pytest.raises(EmptyScope):
        require_rows(scope(claims, Scope(lob="nope")))


def test_segment_rates_keep_zero_cells(claims, rows):
    rates = segments.theme_segments(claims, ["platform"], theme="pricing").collect()
    assert {r["value"] for r in rates} == {"NORTH", "SOUTH"} and 0 in {r["pended"] for r in rates}
    north = [r for r in rows if r["platform"] == "NORTH"]
    match = next(r for r in segments.theme_segments(claims, ["platform"], theme="provider_match").collect() if r["value"] == "NORTH")
    hits = sum(r["theme"] == "provider_match" for r in north)
    assert match["pended"] == hits and match["per_1000"] == round(hits / len(north) * 1000, 1)
    with pytest.raises(ValueError):
        segments.hotspots(claims, "provider_id")


def test_hotspots_and_most_affected(claims):
    cells = segments.hotspots(claims, "platform").collect()
    assert max(c["heat"] for c in cells) == 6 and min(c["heat"] for c in cells) >= 0
    leaders = segments.most_affected(claims).collect()
    assert max(r["position"] for r in leaders) == 2
    hottest = [r for r in leaders if r["hottest"]]
    assert len(hottest) == len({r["theme"] for r in leaders})
    totals = segments.segment_totals(claims, "platform").collect()
    assert totals[0]["per_1000"] >= totals[-1]["per_1000"]


def test_journey(claims, rows):
    stages = journey.journey_stages(claims).collect()
    assert [s["stage"] for s in stages] == ["intake", "pre_adjudication", "adjudication", "post_adjudication"]
    assert sum(s["pended"] for s in stages) == sum(r["pended"] for r in rows)
    channels = journey.intake_by_channel(claims).collect()
    assert channels[0]["channel"] == "paper" and channels[0]["avg_intake_days_clean"] > 0.5
    assert journey.journey_themes(claims).collect()[-1]["key"] == "needs_review"


def test_interventions_and_business_case(claims, rows):
    plan = interventions.interventions(claims).collect()
    assert [r["rank"] for r in plan] == list(range(1, len(plan) + 1)) and "needs_review" not in {r["key"] for r in plan}
    assert [r["priority_score"] for r in plan] == sorted((r["priority_score"] for r in plan), reverse=True)
    top = plan[0]
    assert top["recoverable_days"] == round(top["pend_days"] * top["addressability"])
    assert interventions.interventions(claims, top_n=0).count() == 1 and interventions.interventions(claims, top_n=99).count() == min(12, len(plan))
    basis = kpis.volume_basis(claims).first()
    assert (basis["days_in_window"], basis["claims_in_window"]) == (DAYS - 1, len(rows))
    assert basis["claims_per_year"] == round(len(rows) * 365 / (DAYS - 1))
    case = interventions.business_case(claims).first()
    scale = 0.7 * (basis["claims_per_year"] / len(rows))
    assert case["days_per_year"] == round(sum(r["recoverable_days"] for r in plan[:3]) * scale)


def test_findings(claims):
    told = findings.key_findings(claims).collect()
    assert [f["kind"] for f in told] == ["impact", "frequent_but_quick", "emerging", "visibility"]
    assert told[1]["theme"] == "duplicate" and told[2]["driver_value"] == "NORTH" and told[2]["onset"] == RISE_FROM.isoformat()
    only_review = claims.withColumn("theme", F.expr("if(pended, 'needs_review', NULL)"))
    assert findings.key_findings(only_review).count() == 0
    assert findings.key_findings(claims.filter("NOT pended")).count() == 0
    same = claims.filter("theme = 'duplicate' OR NOT pended")
    assert [f["kind"] for f in findings.key_findings(same).collect()] == ["impact", "visibility"]


def test_other_contrast_when_the_quickest_theme_is_not_frequent(claims):
    mixed = claims.filter("NOT pended OR theme IN ('medical_records', 'provider_match')")
    kinds = {f["kind"].split("_")[0]: f for f in findings.key_findings(mixed).collect()}
    table = {r["key"]: r for r in themes.theme_table(mixed).collect()}
    quick = min(table.values(), key=lambda r: r["avg_pend_days"])
    if quick["claims_share"] > 2 * quick["pend_days_share"]:
        assert kinds["frequent"]["theme"] == quick["key"]
    else:
        assert "contrast" not in kinds or kinds["frequent"]["theme"] == max(table.values(), key=lambda r: r["claims"])["key"]


def test_search_is_literal_and_case_blind(claims):
    assert browse.find_claims(claims, query=".*").count() == 1
    assert browse.find_claims(claims, query="  100% OF ").count() == 1
    assert browse.find_claims(claims, query="c2600000003").count() <= 1
    assert browse.find_claims(claims, theme="duplicate", query="DUPLICATE").count() == browse.find_claims(claims, theme="duplicate").count()
    assert browse.find_claims(claims, status="Denied").count() == 1
    assert browse.find_claims(claims, over_target=True).count() == claims.filter("pended AND over_target").count()


def test_pages_cover_everything_once(claims):
    total = browse.claim_count(claims).first()["total"]
    seen, page = [], 1
    while rows := browse.claim_list(claims, page=page, size=40).collect():
        seen += [r["claim_id"] for r in rows]
        page += 1
    assert len(seen) == total == len(set(seen))
    last = claims.filter(F.col("claim_id") == seen[39]).first()
    following = browse.claims_after(claims, last["pend_s"], last["claim_id"], size=40)
    assert [r["claim_id"] for r in following.collect()] == seen[40:80]
    for bad in ({"page": 0}, {"size": 4}, {"size": 101}):
        with pytest.raises(ValueError):
            browse.claim_list(claims, **bad)


def test_detail_and_timeline(claims):
    unknown_code = claims.filter("denial_code = '999'").first()["claim_id"]
    row = browse.claim_detail(claims, f" {unknown_code.lower()} ").first()
    assert row["denial_code"] == "999" and row["denial_text"] is None and row["theme_name"]
    assert browse.claim_detail(claims, "C2699999999").count() == 0
    steps = browse.claim_timeline(claims).orderBy("claim_id", "seq").collect()
    by_claim: dict[str, list] = {}
    for s in steps:
        by_claim.setdefault(s["claim_id"], []).append(s)
    assert len(by_claim) == claims.count()
    for events in by_claim.values():
        assert [e["at"] for e in events] == sorted(e["at"] for e in events) and [e["seq"] for e in events] == list(range(1, len(events) + 1))
    still_held = claims.filter("theme = 'cob'").first()["claim_id"]
    assert "Pend released" not in {e["event"] for e in by_claim[still_held]}


def test_top_lists(claims):
    providers = themes.top_providers(claims).filter("theme = 'duplicate'").collect()
    assert len(providers) == 5 and [p["claims"] for p in providers] == sorted((p["claims"] for p in providers), reverse=True)
    notes = themes.sample_notes(claims).filter("theme = 'duplicate'").collect()
    assert len(notes) == 6
    profile = themes.cluster_profile(claims).collect()
    assert all(p["cluster_id"] for p in profile) and not any(p["theme"] == "pricing" for p in profile)


def test_results_do_not_depend_on_partitioning(claims):
    shuffled = claims.repartition(7, "provider_id")
    for operator in (kpis.kpis, themes.theme_table, emerging.emerging, segments.most_affected):
        assert operator(shuffled).collect() == operator(claims).collect()


def test_window_limits():
    assert check_window(FIRST, FIRST + timedelta(days=62)) == 63
    for days in (19, 61):
        with pytest.raises(ValueError, match="63"):
            check_window(FIRST, FIRST + timedelta(days=days))
    assert check_window(FIRST, FIRST + timedelta(days=999)) == 1000
