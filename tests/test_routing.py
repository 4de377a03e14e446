"""Questions with the tool and arguments they must lead to."""

from __future__ import annotations

import pytest

from pendscope.operators.routing import DIMENSION_WORDS, THEME_WORDS, route_questions

CASES = (
    ("Where should we intervene first?", "recommend_interventions", {"top_n": 3}),
    ("show me c2612345678 please", "lookup_claim", {"claim_id": "C2612345678"}),
    ("what about C261234567 then", "summary", {}),
    ("Is anything getting worse?", "find_emerging_themes", {}),
    ("Any new spikes in fraud", "find_emerging_themes", {}),
    ("Why do prior authorization claims pend?", "explain_theme", {"theme": "prior_auth"}),
    ("Which platform has the highest pend rate?", "compare_segments", {"dimension": "platform"}),
    ("duplicate claims by platform", "compare_segments", {"dimension": "platform", "theme": "duplicate"}),
    ("At which stage do claims get stuck", "stage_breakdown", {}),
    ("which theme costs the most days", "rank_delay_themes", {"metric": "pend_days"}),
    ("how many claims per theme", "rank_delay_themes", {"metric": "claims"}),
    ("which cause takes longest", "rank_delay_themes", {"metric": "avg_pend_days"}),
    ("how are we doing", "summary", {}),
    # parts of words count, so these lead to a theme
    ("we are waiting", "explain_theme", {"theme": "provider_match"}),
    ("who left", "explain_theme", {"theme": "payment_hold"}),
    # an early word decides even when a theme is named
    ("fraud claims, what comes first", "recommend_interventions", {"top_n": 3}),
    ("\n\t my PA \n", "explain_theme", {"theme": "prior_auth"}),
)


def test_cases(spark):
    df = spark.createDataFrame([(i, text) for i, (text, _, _) in enumerate(CASES)], "id int, text string")
    routed = {r["id"]: r for r in route_questions(df).collect()}
    for i, (text, tool, args) in enumerate(CASES):
        row = routed[i]
        assert row["tool"] == tool, text
        for name in ("claim_id", "theme", "dimension", "metric", "top_n"):
            assert row[name] == args.get(name), (text, name)


@pytest.mark.parametrize("catalogue, column, tool", [(THEME_WORDS, "theme", "explain_theme"), (DIMENSION_WORDS, "dimension", "compare_segments")])
def test_every_key_is_reachable(spark, catalogue, column, tool):
    words = [(key, f"zz {word} zz") for key, group in catalogue.items() for word in group]
    got = route_questions(spark.createDataFrame(words, "key string, text string")).filter(f"tool = '{tool}'").select("key", column).collect()
    assert {r["key"] for r in got if r["key"] == r[column]} == set(catalogue)


def test_length_limits_mark_but_keep_rows(spark):
    df = spark.createDataFrame([("",), ("a" * 1000,), ("a" * 1001,)], "text string")
    assert [r["accepted"] for r in route_questions(df).collect()] == [False, True, False]
