"""An additive cube: what the overview needs of the claims, summed per day and combination of dimensions.

A row holds the sums of the claims that share a receipt day, the six dimensions, theme, stage and state, with their holds
as counted seconds, so KPIs, themes with exact medians, segments, stages and daily series of any scope follow from a few
small rows instead of the claims. Nothing in it hangs on the reporting day: a hold that still runs is kept by its start,
and whether an unfinished claim is late follows from its receipt day. So a day's rows change only with that day's claims,
and :func:`update_cube` writes anew the months of the changed days alone."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.config import AS_OF_LAG_DAYS, GENERIC_PEND_CODE, SEGMENT_DIMENSIONS, SLA_DAYS, STAGE_ORDER
from pendscope.functions.columns import DAY_SECONDS, exclude_null, share_sql
from pendscope.operators import journey, kpis, segments, themes, trends
from pendscope.operators.measures import STAGE_BOUNDS

KEYS = ("received_date", *SEGMENT_DIMENSIONS, "pended", "theme", "pend_stage", "unfinished", "held")
SUMS = ("claims", "late", "tat_s", "tat_n", "touches", "billed", "denied", "generic", *(f"{stage}_{part}" for stage in STAGE_ORDER for part in "sn"))


def cube(claims: DataFrame, sla_days: int = SLA_DAYS) -> DataFrame:
    """``KEYS``, ``SUMS`` and ``holds`` (array of seconds and their number). ``late`` counts finished claims over the
    target; a hold of ``held`` rows, which still run, is the second it began."""
    def seconds(start: str, end: str) -> str:
        return f"unix_seconds({end}) - unix_seconds({start})"

    rows = claims.withColumns({
        "unfinished": F.expr("finalized_ts IS NULL"), "held": F.expr("pended AND released_ts IS NULL"),
        "theme": F.expr("if(pended, theme, NULL)"), "pend_stage": F.expr("if(pended, pend_stage, NULL)"),
        "hold": F.expr(f"CASE WHEN NOT pended THEN NULL WHEN released_ts IS NULL THEN unix_seconds(pended_ts) ELSE {seconds('pended_ts', 'released_ts')} END"),
    })
    tat = seconds("received_ts", "finalized_ts")
    sums = {
        "claims": "count(*)", "late": f"count_if({tat} > {sla_days * DAY_SECONDS})", "tat_s": f"coalesce(sum({tat}), 0L)", "tat_n": "count(finalized_ts)",
        "touches": "coalesce(sum(cast(touches AS bigint)), 0L)", "billed": "coalesce(sum(billed_amount), 0)", "denied": "count_if(status = 'Denied')",
        "generic": f"count_if(pend_code = '{GENERIC_PEND_CODE}')",
    }
    for stage, (start, end) in STAGE_BOUNDS.items():
        sums |= {f"{stage}_s": f"coalesce(sum({seconds(start, end)}), 0L)", f"{stage}_n": f"count({seconds(start, end)})"}
    counted = rows.groupBy(*KEYS, "hold").agg(*(F.expr(f"{text} AS {name}") for name, text in sums.items()))
    return counted.groupBy(*KEYS).agg(
        *(F.sum(name).alias(name) for name in SUMS),
        F.expr("sort_array(collect_list(if(hold IS NULL, NULL, struct(hold AS s, claims AS n)))) AS holds"))


def write_cube(claims: DataFrame, path: str) -> None:
    """The cube by month of receipt. Months that ``claims`` has rows of are replaced, others stay."""
    by_month = cube(claims).withColumn("month", F.date_trunc("month", "received_date").cast("date"))
    by_month.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def update_cube(claims: DataFrame, path: str, days: Sequence[date]) -> None:
    """Writes the months of the changed ``days`` anew from all their claims; ``claims`` is pruned to them."""
    months = sorted({day.replace(day=1) for day in days})
    if months:
        inside = F.col("received_date") >= F.lit(months[0])  # prunes the days before the first month
        write_cube(claims.filter(inside & F.date_trunc("month", "received_date").cast("date").isin(months)), path)


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_of(rows: DataFrame, lag: int = AS_OF_LAG_DAYS) -> Column:
    """The reporting day of a whole cube, as a scalar subquery; take it before narrowing the scope."""
    return F.date_add(rows.agg(F.max("received_date")).scalar(), lag)


def at(rows: DataFrame, day: Column, sla_days: int = SLA_DAYS) -> DataFrame:
    """Cube rows as of a day: ``holds`` are lengths, and ``over_target`` counts unfinished claims too."""
    now = F.unix_seconds(day.cast("timestamp"))
    return rows.withColumn("now", now).withColumns({
        "holds": F.expr("transform(holds, h -> struct(if(held, now - h.s, h.s) AS s, h.n AS n))"),
        # the reporting day begins at midnight, so an unfinished claim is late by its receipt day
        "over_target": F.when(F.col("unfinished"), F.expr("claims") * (F.datediff(day, "received_date") > sla_days).cast("long")).otherwise(F.col("late")),
    }).drop("now")


def _sum(value: str, where: str) -> str:
    return f"sum(if({where}, {value}, NULL))"


def _mean(prefix: str, where: str) -> str:
    return share_sql(_sum(f"{prefix}_s", where), f"({_sum(f'{prefix}_n', where)} * {DAY_SECONDS})")


_HELD_S, _HELD_N = "aggregate(holds, 0L, (t, h) -> t + h.s * h.n)", "aggregate(holds, 0L, (t, h) -> t + h.n)"


def kpis_of(rows: DataFrame, sla_days: int = SLA_DAYS) -> DataFrame:
    sums = rows.withColumns({"hold_s": F.expr(_HELD_S), "hold_n": F.expr(_HELD_N)})
    held = "coalesce({}, 0L)".format
    return kpis.kpi_row(sums, {
        "claims": held("sum(claims)"),
        "pended": held(_sum("claims", "pended")),
        "pended_rate": share_sql(held(_sum("claims", "pended")), "sum(claims)"),
        "first_pass_rate": f"1 - {share_sql(held(_sum('claims', 'pended')), 'sum(claims)')}",
        "avg_days_clean": _mean("tat", "NOT unfinished AND NOT pended"),
        "avg_days_pended": _mean("tat", "NOT unfinished AND pended"),
        "avg_pend_days": _mean("hold", "pended"),
        "pend_days_total": f"{held(_sum('hold_s', 'pended'))} / 86400D",
        "manual_touches": held(_sum("touches", "pended")),
        "over_target": held("sum(over_target)"),
        "over_target_pended_share": share_sql(held(_sum("over_target", "pended")), "sum(over_target)"),
        "open_pended": held(_sum("claims", "held")),
        "open_pended_billed": f"coalesce({_sum('billed', 'held')}, 0)",
    }, sla_days)


def themes_of(rows: DataFrame) -> DataFrame:
    """The theme table. Holds come as counted seconds; all other sums ride on one row without a hold."""
    pended = rows.filter("pended").withColumn("timed", F.expr(_HELD_N))
    zero = "0L AS {}".format
    others = {"billed": "billed", "touches": "touches", "over_target": "over_target", "open": "if(held, claims, 0L)", "denied": "denied", "generic": "generic"}
    rest = pended.groupBy("theme").agg(F.expr("sum(claims - timed) AS claims"), *(F.expr(f"sum({text}) AS {name}") for name, text in others.items()))
    rest = rest.select("theme", F.lit(None).cast("long").alias("pend_s"), F.struct("claims", *others).alias("f"))
    held = pended.selectExpr("theme", "inline_outer(holds) AS (pend_s, n)").filter("n IS NOT NULL").groupBy("theme", "pend_s").agg(F.sum("n").alias("claims"))
    money = rest.schema["f"].dataType["billed"].dataType.simpleString()
    held = held.withColumn("billed", F.lit(0).cast(money)).selectExpr(
        "theme", "pend_s", f"struct(claims, billed, {', '.join(zero(name) for name in others if name != 'billed')}) AS f")
    return themes.theme_table_of(held.unionByName(rest))


def segments_of(rows: DataFrame, dimensions: Sequence[str] = SEGMENT_DIMENSIONS, theme: str | None = None) -> DataFrame:
    return segments.segment_table(segments.lay_out(rows.groupBy("theme", *dimensions).agg(F.sum("claims").alias("n")), dimensions), theme)


def stages_of(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"hold_s": F.expr(_HELD_S), "hold_n": F.expr(_HELD_N)})
    sums = {"all_pended": "coalesce(" + _sum("claims", "pended") + ", 0L)", "all_pend_s": _sum("if(hold_n > 0, hold_s, NULL)", "pended")}
    for i, stage in enumerate(STAGE_ORDER):
        here = f"pended AND pend_stage = '{stage}'"
        sums |= {
            f"n{i}": f"coalesce({_sum('claims', here)}, 0L)", f"s{i}": f"coalesce({_sum('hold_s', here)}, 0L)",
            f"clean{i}": _mean(stage, "NOT pended"), f"here{i}": _mean(stage, here), f"held{i}": _mean(stage, "pended")}
    return journey.stage_table(rows, sums)


def daily_of(rows: DataFrame) -> DataFrame:
    counts = exclude_null(rows, "received_date").groupBy("received_date").agg(
        F.sum("claims").alias("received"), F.expr("sum(if(pended, claims, 0L)) AS pended"))
    return trends.fill_overview(counts)


def daily_themes_of(rows: DataFrame) -> DataFrame:
    counts = exclude_null(rows, "received_date").groupBy("received_date", F.col("theme").alias("key")).agg(F.sum("claims").alias("n"))
    return trends.fill_days(counts)


def overview_of(rows: DataFrame) -> dict[str, DataFrame]:
    """Six outputs from cube rows as of :func:`at`, narrowed by any scope."""
    return {"kpis": kpis_of(rows), "themes": themes_of(rows), "segments": segments_of(rows), "stages": stages_of(rows), "daily": daily_of(rows),
            "daily_themes": daily_themes_of(rows)}
