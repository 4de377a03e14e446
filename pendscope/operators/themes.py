"""Delay themes: what holds claims up, and for how long."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pendscope.config import GENERIC_PEND_CODE, RANK_METRICS
from pendscope.functions.columns import (
    aggregates, days, exclude_null, over_all, round_to, rounded, rounded_by_product, share_sql,
)
from pendscope.functions.exact_median import counted_quantile
from pendscope.sources.playbook import theme_dim, with_advice


_SUMS = {
    "claims": "count(*)",
    "billed": "sum(billed_amount)",
    "touches": "sum(touches)",
    "over_target": "count_if(over_target)",
    "open": "count_if(released_ts IS NULL)",
    "denied": "count_if(status = 'Denied')",
    "generic": f"count_if(pend_code = '{GENERIC_PEND_CODE}')",
}


def per_hold(claims: DataFrame) -> DataFrame:
    """(theme, pend_s, f): sums of the pended claims per theme and length of hold, in one struct. Figures and medians both
    start here, and as both take the whole struct they share one exchange."""
    return claims.filter("pended").groupBy("theme", "pend_s").agg(F.struct(*aggregates(_SUMS)).alias("f"))


def hold_quantile(holds: DataFrame, q: float = 0.5) -> DataFrame:
    """(theme, quantile) of the hold in seconds, from :func:`per_hold`."""
    return counted_quantile(exclude_null(holds, "theme").selectExpr("theme", "pend_s", "f.claims AS n"), "theme", "pend_s", q)


def theme_totals(claims: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """Sums per theme with the scope totals on each row; at most one row per theme.

    Claims without a theme count towards the totals but form no group."""
    if holds is None:
        grouped = claims.filter("pended").groupBy("theme").agg(*aggregates({"pend_s": "sum(pend_s)", "timed": "count(pend_s)", **_SUMS}))
    else:
        grouped = holds.groupBy("theme").agg(*aggregates({
            "sum_s": "sum(pend_s * f.claims)", "timed": "sum(if(pend_s IS NULL, 0, f.claims))", **{name: f"sum(f.{name})" for name in _SUMS}}))
        grouped = grouped.withColumnRenamed("sum_s", "pend_s")
    totals = [f"sum({name}) OVER (PARTITION BY 0) AS all_{name}" for name in ("claims", "pend_s", "generic")]
    return exclude_null(grouped.selectExpr("*", *totals), "theme")


def with_names(df: DataFrame, key: str = "theme") -> DataFrame:
    """Adds theme name and stage; a theme outside the catalogue keeps nulls."""
    names = theme_dim(df.sparkSession).select(
        F.col("theme").alias(key), F.col("theme_name").alias("name"), "stage", "stage_name")
    return df.join(F.broadcast(names), key, "left")


def theme_figures(claims: DataFrame, holds: DataFrame | None = None) -> DataFrame:
    """Rounded theme figures without the median, from the claims or from :func:`per_hold` of them."""
    figures = theme_totals(claims, holds).selectExpr(
        "theme",
        "claims",
        f"{share_sql('claims', 'all_claims')} AS claims_share",
        f"{share_sql('pend_s', 'timed * 86400')} AS avg_pend_days",
        "pend_s / 86400D AS pend_days",
        f"{share_sql('pend_s', 'all_pend_s')} AS pend_days_share",
        "billed",
        "touches",
        "over_target",
        "open",
        f"{share_sql('denied', 'claims')} AS denied_share",
        f"{share_sql('all_generic', 'all_claims')} AS generic_share",
    )
    shares = dict.fromkeys(("claims_share", "pend_days_share", "denied_share", "generic_share"), 4)
    return with_names(round_to(figures, shares | {"avg_pend_days": 1, "pend_days": 0, "billed": 0}))


THEME_TABLE_COLUMNS = (
    "key", "name", "stage", "stage_name", "claims", "claims_share", "avg_pend_days", "median_pend_days", "pend_days",
    "pend_days_share", "billed", "touches", "over_target", "open", "denied_share",
)


def theme_table(claims: DataFrame) -> DataFrame:
    """One row per theme, most days lost first."""
    return theme_table_of(per_hold(claims))


def theme_table_of(holds: DataFrame) -> DataFrame:
    """:func:`theme_table` from sums as of :func:`per_hold`."""
    table = theme_figures(holds, holds).join(F.broadcast(hold_quantile(holds)), "theme", "left")
    return (
        table.withColumns({"key": F.col("theme"), "median_pend_days": rounded("quantile / 86400D", 1)})
        .select(*THEME_TABLE_COLUMNS)
        .orderBy(F.desc("pend_days"), "key")
    )


RANKING_COLUMNS = (
    "key", "name", "stage_name", "claims", "claims_share", "avg_pend_days", "pend_days", "pend_days_share",
    "over_target", "open",
)


def rank_themes(claims: DataFrame, metric: str = "pend_days") -> DataFrame:
    """Themes by a chosen metric; an unknown metric ranks by days lost."""
    metric = metric if metric in RANK_METRICS else RANK_METRICS[0]
    ordered = over_all().orderBy(F.desc(metric), F.desc("pend_days"), "key")
    figures = theme_figures(claims).withColumnRenamed("theme", "key").select(*RANKING_COLUMNS)
    return figures.withColumn("position", F.row_number().over(ordered)).orderBy("position")


def theme_catalogue(claims: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """All catalogue themes with their playbook and their number of pended claims."""
    counts = exclude_null(claims.filter("pended"), "theme").groupBy("theme").agg(F.count("*").alias("claims"))
    return with_advice(theme_dim(claims.sparkSession), advice).join(F.broadcast(counts), "theme", "left").fillna(0, ["claims"])


def theme_playbook(claims: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """What the user's ``advice`` says about the themes present in the scope."""
    present = exclude_null(claims.filter("pended"), "theme").select("theme").distinct()
    told = with_advice(theme_dim(claims.sparkSession), advice).select("theme", "theme_name", "stage_name", "plain", "why", "intervention", "owner")
    return present.join(F.broadcast(told), "theme", "left")


def cluster_profile(claims: DataFrame, catalogue: DataFrame | None = None) -> DataFrame:
    """Root-cause clusters of every theme, largest first; shares are of the theme."""
    per_cluster = exclude_null(claims.filter("pended"), "theme").groupBy("theme", "cluster_id").agg(*aggregates(
        {"claims": "count(*)", "pend_s": "sum(pend_s)", "timed": "count(pend_s)"}))
    per_cluster = per_cluster.selectExpr("*", "sum(claims) OVER (PARTITION BY theme) AS in_theme")
    profile = round_to(exclude_null(per_cluster, "cluster_id").selectExpr(
        "theme", "cluster_id", "claims", f"{share_sql('claims', 'in_theme')} AS share",
        f"{share_sql('pend_s', 'timed * 86400')} AS avg_pend_days", "pend_s / 86400D AS pend_days",
    ), {"share": 4, "avg_pend_days": 1, "pend_days": 0})
    if catalogue is not None:
        words = catalogue.select("cluster_id", "key_phrases", "example_note")
        profile = profile.join(words, "cluster_id", "left").withColumn(
            "key_phrases", F.coalesce("key_phrases", F.expr("cast(array() AS array<string>)")))
    return profile.orderBy("theme", F.desc("claims"), "cluster_id")


def top_providers(claims: DataFrame, k: int = 5) -> DataFrame:
    """The k providers with most pended claims in each theme. Counting is partial
    before the shuffle and the ranking keeps k rows per theme in every task."""
    per_provider = exclude_null(claims.filter("pended"), "theme", "provider_id").groupBy("theme", "provider_id").agg(
        F.count("*").alias("claims"), F.min_by("specialty", "claim_id").alias("specialty"))
    best = Window.partitionBy("theme").orderBy(F.desc("claims"), "provider_id")
    return (
        per_provider.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)
        .orderBy("theme", "position")
    )


def sample_notes(claims: DataFrame, k: int = 6) -> DataFrame:
    """The k longest-held claims of each theme with their notes."""
    longest = Window.partitionBy("theme").orderBy(F.desc("pend_s"), "claim_id")
    return (
        exclude_null(claims.filter("pended"), "theme")
        .select("theme", "claim_id", "adjuster_note", "pend_code", "pend_s", "confidence")
        .withColumn("position", F.row_number().over(longest))
        .filter(F.col("position") <= k)
        .select("theme", "position", "claim_id", "adjuster_note", "pend_code",
                rounded_by_product(days(F.col("pend_s")), 1).alias("pend_days"), "confidence")
        .orderBy("theme", "position")
    )
