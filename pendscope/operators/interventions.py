"""Where to act first, and what it would be worth."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.config import MOST_INTERVENTIONS
from pendscope.functions.columns import aggregates, rounded
from pendscope.operators.kpis import volume_basis
from pendscope.operators.themes import hold_quantile, per_hold, theme_figures
from pendscope.sources.playbook import effort_dim, playbook, with_advice

def _plan(claims: DataFrame, advice: DataFrame | None = None, holds: DataFrame | None = None) -> DataFrame:
    """Themes with advice, ranked. Removable days come from the rounded days lost;
    the score from the removable days before rounding."""
    spark = claims.sparkSession
    rules = with_advice(playbook(spark), advice).join(F.broadcast(effort_dim(spark)), "effort_level").select(
        "theme", "addressability", "effort", "effort_level", "effort_weight", "intervention", "owner", "why")
    scored = theme_figures(claims, holds).join(F.broadcast(rules), "theme").selectExpr(
        "*", "rint(pend_days * addressability) AS recoverable_days",
        "cast(rint(claims * addressability) AS bigint) AS recoverable_claims",
        "cast(rint(touches * addressability) AS bigint) AS recoverable_touches",
        "rint(pend_days * addressability / effort_weight) AS priority_score")
    return scored.selectExpr(
        "*", "row_number() OVER (PARTITION BY 0 ORDER BY priority_score DESC, pend_days DESC, theme) AS rank")


PLAN_COLUMNS = (
    "rank", "key", "name", "stage", "stage_name", "claims", "claims_share", "avg_pend_days", "pend_days",
    "pend_days_share", "billed", "touches", "over_target", "open", "denied_share", "intervention", "owner", "why",
    "addressability", "effort", "effort_level", "recoverable_days", "recoverable_claims", "recoverable_touches",
    "priority_score",
)


def interventions(claims: DataFrame, top_n: int | None = None, with_median: bool = True, advice: DataFrame | None = None) -> DataFrame:
    """Themes by removable days per unit of effort; ``top_n`` is held between 1 and 12, None gives the whole plan. ``advice`` holds the user's texts."""
    holds = per_hold(claims) if with_median else None
    plan = _plan(claims, advice, holds)
    columns = list(PLAN_COLUMNS)
    if top_n is not None:
        plan = plan.filter(F.col("rank") <= max(1, min(top_n, MOST_INTERVENTIONS)))
    if with_median:
        plan = plan.join(F.broadcast(hold_quantile(holds)), "theme", "left").withColumn(
            "median_pend_days", rounded("quantile / 86400D", 1))
        columns.append("median_pend_days")
    return plan.withColumnRenamed("theme", "key").select(*columns).orderBy("rank")


def business_case(
    claims: DataFrame, themes: Sequence[str] | None = None, top_n: int = 3,
    cost_per_touch: float = 8.0, realised: float = 0.7, volume: int | None = None,
) -> DataFrame:
    """Yearly effect of the chosen themes (by default the first three of the plan),
    scaled from the scope to ``volume`` claims a year."""
    plan = _plan(claims)
    listed = ", ".join(f"'{theme}'" for theme in themes or ())
    chosen = f"rank <= {int(top_n)}" if themes is None else (f"theme IN ({listed})" if listed else "false")
    units = ("touches", "days", "claims")
    sums = plan.agg(*aggregates(
        {"chosen": f"count_if({chosen})", "available": "count(*)"}
        | {unit: f"cast(coalesce(sum(if({chosen}, recoverable_{unit}, 0)), 0) AS double)" for unit in units}))
    basis = volume_basis(claims)
    yearly = basis.select("claims_per_year").scalar() if volume is None else F.lit(volume)
    per_year = F.try_divide(yearly.cast("double"), basis.select("claims_in_window").scalar().cast("double"))
    return sums.withColumn("scale", F.lit(realised) * per_year).selectExpr(
        "chosen", "available", *(f"rint({unit} * scale) AS {unit}_per_year" for unit in units),
        f"rint(touches * scale * cast({cost_per_touch} AS double)) AS cost_avoided")
