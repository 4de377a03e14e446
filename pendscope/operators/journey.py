"""Where on their way claims are held up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.config import NEEDS_REVIEW, STAGE_ORDER
from pendscope.functions.columns import aggregates, exclude_null, mean_days_sql, round_to, share_sql
from pendscope.operators.themes import theme_figures
from pendscope.sources.playbook import stage_dim


def journey_stages(claims: DataFrame) -> DataFrame:
    """One row per stage. All stages come from one pass that yields a single row of
    sums, which is then laid out as four rows."""
    sums = {"all_pended": "count_if(pended)", "all_pend_s": "sum(if(pended, pend_s, NULL))"}
    for i, stage in enumerate(STAGE_ORDER):
        here = f"pended AND pend_stage = '{stage}'"
        sums |= {
            f"n{i}": f"count_if({here})",
            f"s{i}": f"coalesce(sum(if({here}, pend_s, NULL)), 0L)",
            f"clean{i}": mean_days_sql(f"{stage}_s", "NOT pended"),
            f"here{i}": mean_days_sql(f"{stage}_s", here),
            f"held{i}": mean_days_sql(f"{stage}_s", "pended"),
        }
    return stage_table(claims, sums)


def stage_table(claims: DataFrame, sums: dict[str, str]) -> DataFrame:
    """The stages from their sums, given as SQL text: n, s, clean, here and held of each, and the totals."""
    layout = [f"'{stage}', n{i}, s{i}, clean{i}, here{i}, held{i}" for i, stage in enumerate(STAGE_ORDER)]
    rows = claims.agg(*aggregates(sums)).selectExpr(
        "all_pended", "all_pend_s",
        f"stack({len(STAGE_ORDER)}, {', '.join(layout)}) AS "
        "(stage, pended, pend_s, avg_days_clean, avg_days_when_pended_here, avg_days_all_pended)")
    named = rows.join(F.broadcast(stage_dim(claims.sparkSession)), "stage").orderBy("stage_ord")
    table = named.selectExpr(
        "stage", "stage_name", "pended", f"{share_sql('pended', 'all_pended')} AS pended_share",
        "pend_s / 86400D AS pend_days", f"{share_sql('pend_s', 'all_pend_s')} AS pend_days_share",
        "avg_days_clean", "avg_days_when_pended_here", "avg_days_all_pended")
    averages = dict.fromkeys(("avg_days_clean", "avg_days_when_pended_here", "avg_days_all_pended"), 2)
    return round_to(table, averages | {"pended_share": 4, "pend_days": 0, "pend_days_share": 4})


def journey_themes(claims: DataFrame) -> DataFrame:
    """Themes under their playbook stage; ``needs_review`` comes without a stage."""
    figures = theme_figures(claims).join(F.broadcast(stage_dim(claims.sparkSession).select("stage", "stage_ord")), "stage", "left")
    return (
        figures.filter(F.col("stage").isNotNull() | (F.col("theme") == NEEDS_REVIEW))
        .orderBy(F.asc_nulls_last("stage_ord"), F.desc("pend_days"), "theme")
        .select("stage", F.col("theme").alias("key"), "name", "claims", "claims_share", "avg_pend_days", "pend_days", "pend_days_share")
    )


def journey_totals(claims: DataFrame) -> DataFrame:
    """Days over all stages, for clean and for pended claims."""
    sums = journey_stages(claims).agg(*aggregates({
        "clean_days": "sum(coalesce(avg_days_clean, 0D))", "pended_days": "sum(coalesce(avg_days_all_pended, 0D))"}))
    return round_to(sums, {"clean_days": 2, "pended_days": 2})


def intake_by_channel(claims: DataFrame) -> DataFrame:
    """Intake by channel, slowest first: some are slow even when nothing is held."""
    at_intake = "count_if(pended AND pend_stage = 'intake')"
    table = exclude_null(claims, "channel").groupBy("channel").agg(*aggregates({
        "claims": "count(*)",
        "avg_intake_days_clean": mean_days_sql("intake_s", "NOT pended"),
        "intake_pends_per_1000": f"{share_sql(at_intake, 'count(*)')} * 1000",
        "intake_pended": at_intake,
    }))
    table = round_to(table, {"avg_intake_days_clean": 2, "intake_pends_per_1000": 1})
    return table.orderBy(F.expr("coalesce(avg_intake_days_clean, 0D)").desc(), "channel")
