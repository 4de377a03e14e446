"""Checks that the outputs of one scope agree with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.operators.journey import journey_stages
from pendscope.operators.kpis import kpis
from pendscope.operators.themes import theme_figures
from pendscope.operators.trends import daily_by_theme, daily_overview


def reconcile(claims: DataFrame) -> DataFrame:
    """(name, left_side, right_side, passed), one row per check. Rounded day sums may be
    off by one day per theme."""
    head = kpis(claims).selectExpr("claims AS k_claims", "pended AS k_pended", "pend_days_total AS k_days")
    daily = daily_overview(claims).agg(F.sum("received").alias("d_received"), F.sum("pended").alias("d_pended"))
    themes = theme_figures(claims).agg(F.sum("claims").alias("t_claims"), F.sum("pend_days").alias("t_days"), F.count("*").alias("t_rows"))
    stages = journey_stages(claims).agg(F.sum("pended").alias("s_pended"))
    series = daily_by_theme(claims).agg(F.sum("pended").alias("x_pended"))
    sides = (
        ("daily received", "d_received", head, "k_claims", 0), ("daily pended", "d_pended", head, "k_pended", 0),
        ("theme claims", "t_claims", head, "k_pended", 0), ("theme days", "t_days", head, "k_days", 1),
        ("stage pended", "s_pended", head, "k_pended", 0), ("theme series", "x_pended", themes, "t_claims", 0),
    )
    source = {"d": daily, "t": themes, "s": stages, "x": series}
    checks = None
    for name, left, other, right, per_theme in sides:
        allowed = themes.select("t_rows").scalar() * per_theme if per_theme else F.lit(0)
        row = source[left[0]].select(
            F.lit(name).alias("name"), F.col(left).cast("double").alias("left_side"),
            other.select(right).scalar().cast("double").alias("right_side"), allowed.cast("double").alias("allowed"))
        checks = row if checks is None else checks.unionByName(row)
    return checks.select("name", "left_side", "right_side", (F.abs(F.col("left_side") - F.col("right_side")) <= F.col("allowed")).alias("passed"))
