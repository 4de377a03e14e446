"""Headline figures of a scope, in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.config import GENERIC_PEND_CODE, MIN_WINDOW_DAYS, SEGMENT_DIMENSIONS, SLA_DAYS, STAGE_ORDER
from pendscope.functions.columns import aggregates, inline_table, mean_days_sql, round_to, share_sql
from pendscope.sources.playbook import REVIEW, THEMES


def kpis(claims: DataFrame, sla_days: int = SLA_DAYS) -> DataFrame:
    """One row. Averages of turnaround cover finished claims only."""
    waiting = "pended AND released_ts IS NULL"
    return kpi_row(claims, {
        "claims": "count(*)",
        "pended": "count_if(pended)",
        "pended_rate": share_sql("count_if(pended)", "count(*)"),
        "first_pass_rate": f"1 - {share_sql('count_if(pended)', 'count(*)')}",
        "avg_days_clean": mean_days_sql("tat_s", "NOT is_open AND NOT pended"),
        "avg_days_pended": mean_days_sql("tat_s", "NOT is_open AND pended"),
        "avg_pend_days": mean_days_sql("pend_s", "pended"),
        "pend_days_total": "coalesce(sum(if(pended, pend_s, 0L)), 0L) / 86400D",
        "manual_touches": "coalesce(sum(if(pended, touches, 0)), 0L)",
        "over_target": "count_if(over_target)",
        "over_target_pended_share": share_sql("count_if(over_target AND pended)", "count_if(over_target)"),
        "open_pended": f"count_if({waiting})",
        "open_pended_billed": f"coalesce(sum(if({waiting}, billed_amount, NULL)), 0)",
    }, sla_days)


def kpi_row(rows: DataFrame, sums: dict[str, str], sla_days: int = SLA_DAYS) -> DataFrame:
    """The figures given as SQL text, rounded as they are shown."""
    row = rows.agg(*aggregates(sums)).withColumn("target_days", F.lit(sla_days))
    rates = dict.fromkeys(("pended_rate", "first_pass_rate", "over_target_pended_share"), 4)
    averages = dict.fromkeys(("avg_days_clean", "avg_days_pended", "avg_pend_days"), 1)
    return round_to(row, rates | averages | {"pend_days_total": 0, "open_pended_billed": 0})


def volume_basis(claims: DataFrame) -> DataFrame:
    """Receipt days seen, claims, and claims per year at that rate."""
    seen = claims.groupBy("received_date").agg(F.count("*").alias("n"))
    return seen.agg(
        F.greatest(F.count("received_date"), F.lit(1)).alias("days_in_window"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("claims_in_window"),
    ).withColumn("claims_per_year", F.expr("cast(rint(claims_in_window * 365 / days_in_window) AS bigint)"))


def generic_code_share(claims: DataFrame) -> DataFrame:
    """Share of pended claims that carry only the general code."""
    generic = f"count_if(pend_code = '{GENERIC_PEND_CODE}')"
    row = claims.filter("pended").agg(*aggregates(
        {"pended": "count(*)", "generic": generic, "generic_code_share": share_sql(generic, "count(*)")}))
    return round_to(row, {"generic_code_share": 4})


META = (
    *(("theme", theme[0]) for theme in (*THEMES, REVIEW)), *(("stage", stage) for stage in STAGE_ORDER),
    *(("dimension", dimension) for dimension in SEGMENT_DIMENSIONS), ("needs_days", str(MIN_WINDOW_DAYS)),
)


def meta(claims: DataFrame, as_of_lag: int = 2) -> DataFrame:
    """Filter values, data limits and what can be asked for (themes, stages, dimensions, days of a window) as (kind, value) rows.

    Values are made distinct together in one pass before they are laid out, so the
    shuffle carries one row per combination, not one per claim."""
    combos = claims.groupBy("lob", "platform", F.expr("if(pended, status, NULL)").alias("status")).agg(
        F.min("received_date").alias("lo"), F.max("received_date").alias("hi"))
    values = combos.selectExpr("stack(3, 'lob', lob, 'platform', platform, 'status', status) AS (kind, value)")
    limits = combos.agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).selectExpr(
        f"stack(3, 'date_min', lo, 'date_max', hi, 'as_of', date_add(hi, {as_of_lag})) AS (kind, day)")
    fixed = inline_table(claims.sparkSession, META, {"kind": "string", "value": "string"})
    return (
        values.filter("value IS NOT NULL").distinct()
        .unionByName(limits.selectExpr("kind", "date_format(day, 'yyyy-MM-dd') AS value")).unionByName(fixed)
        .orderBy("kind", "value")
    )
