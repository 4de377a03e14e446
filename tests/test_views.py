"""Bundles over one scope."""

from __future__ import annotations

import pytest

from pendscope.operators.scope import EmptyScope, Scope
from pendscope.plans import views


def test_overview_reconciles_over_one_kept_scope(claims):
    with views.scoped(claims, Scope(platform="NORTH"), keep=True) as north:
        assert north.storageLevel.useMemory
        parts = views.overview(north)
        head = parts["kpis"].first()
        assert sum(r["received"] for r in parts["daily"].collect()) == head["claims"]
        assert sum(r["claims"] for r in parts["themes"].collect()) == head["pended"]
        assert sum(r["pended"] for r in parts["stages"].collect()) == head["pended"]
        assert parts["interventions"].count() <= 3
    assert not north.storageLevel.useMemory
    with pytest.raises(EmptyScope):
        with views.scoped(claims, Scope(platform="nowhere")):
            pass


def test_theme_detail(spark, claims):
    advice = spark.createDataFrame([("provider_match", "desk", "p", "w", "act")], "theme string, owner string, plain string, why string, intervention string")
    parts = views.theme_detail(claims, "provider_match", advice=advice)
    figures = parts["figures"].first()
    assert sum(r["pended"] for r in parts["daily"].collect()) == figures["claims"]
    assert {r["dimension"] for r in parts["segments"].collect()} == {"platform", "lob", "specialty", "channel", "network_status", "claim_type"}
    assert parts["playbook"].first()["intervention"] == "act"
    assert views.theme_detail(claims, "duplicate", advice=advice)["playbook"].first()["intervention"] is None
    assert views.theme_detail(claims, "fwa_review") is None
    assert views.theme_detail(claims, "needs_review")["playbook"].first()["stage_name"] is None


def test_compare_and_sql_views(spark, claims):
    assert views.compare_segments(claims, "platform", "duplicate").count() == 2
    with pytest.raises(ValueError):
        views.compare_segments(claims, "provider")
    names = views.register_views(claims)
    assert "delay_themes" in names
    assert spark.sql("SELECT max(claims) FROM delay_themes").first()[0] > 0
