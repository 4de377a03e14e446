"""Themes on the rise: the last three weeks against the six weeks before.

The scope is read once for its first and last day and once, inside the nine
weeks only, for all counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.config import (
    BASELINE_DAYS, DIMENSION_LABELS, EMERGING_MIN_LIFT, EMERGING_MIN_Z, RECENT_DAYS, SEGMENT_DIMENSIONS,
)
from pendscope.functions.columns import exclude_null, percent_sql, round_to, share_sql
from pendscope.operators.themes import with_names


@dataclass(frozen=True)
class RiseRule:
    recent: int = RECENT_DAYS
    baseline: int = BASELINE_DAYS
    min_lift: float = EMERGING_MIN_LIFT
    min_z: float = EMERGING_MIN_Z

    @property
    def needs_days(self) -> int:
        return self.recent + self.baseline


def emerging_status(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """Whether the scope is long enough to look for rising themes."""
    span = F.datediff(F.max("received_date"), F.min("received_date")) + 1
    return claims.agg(span.alias("days_in_scope")).select(
        "days_in_scope", (F.col("days_in_scope") >= rule.needs_days).alias("checked"), F.lit(rule.needs_days).alias("needs_days"))


def _window_claims(claims: DataFrame, rule: RiseRule) -> DataFrame:
    """Pended claims of the nine weeks with ``age`` = days before the last day.

    The bounds are scalar subqueries on the day column, so a table partitioned by
    day is pruned at run time. No row is left when the scope is too short."""
    first = claims.agg(F.min("received_date").alias("first")).scalar()
    last = claims.agg(F.max("received_date").alias("last")).scalar()
    in_window = F.col("received_date") > F.date_sub(last, rule.needs_days)
    long_enough = F.datediff(last, first) + 1 >= rule.needs_days
    held = exclude_null(claims.filter("pended"), "theme").filter(in_window & long_enough)
    return held.withColumns({"last_day": last, "age": F.datediff(last, "received_date")})


DAY, CLUSTER = -1, 99


def rise_table(claims: DataFrame, rule: RiseRule = RiseRule(), dimensions: Sequence[str] = SEGMENT_DIMENSIONS) -> DataFrame:
    """One row per theme with a baseline: scores, onset, driver and top cluster.

    The window is read once and counted per combination of day, segment values and
    cluster. Those counts are laid out as days, segment values and clusters, summed,
    and reduced to one row per theme that holds at most one number per day."""
    r, b = rule.recent, rule.baseline
    combos = _window_claims(claims, rule).groupBy("theme", "last_day", "age", *dimensions, "cluster_id").agg(F.count("*").alias("n"))
    parts = [(DAY, "", "age"), *((i, d, d) for i, d in enumerate(dimensions)), (CLUSTER, "", "cluster_id")]
    layout = ", ".join(
        f"named_struct('dim_ord', {i}, 'dimension', '{d}', 'value', cast({column} AS string))" for i, d, column in parts)
    long = combos.selectExpr("theme", "last_day", "age", "n", f"inline(array({layout}))").filter("value IS NOT NULL")
    values = long.groupBy("theme", "last_day", "dim_ord", "dimension", "value").agg(
        F.sum(F.expr(f"if(age < {r}, n, 0)")).alias("now_n"), F.sum(F.expr(f"if(age < {r}, 0, n)")).alias("before_n"))

    # gains per day are compared as whole numbers, so ties are real ties
    themes = values.withColumn("gain", F.expr(f"now_n * {b} - before_n * {r}")).groupBy("theme", "last_day").agg(
        F.expr(f"map_from_entries(array_compact(collect_list(if(dim_ord = {DAY}, struct(int(value), now_n + before_n), NULL))))").alias("counts"),
        F.expr(f"min_by(struct(dimension, value, now_n, before_n, gain), struct(-gain, dim_ord, value)) "
               f"FILTER (WHERE dim_ord NOT IN ({DAY}, {CLUSTER}) AND now_n > 0)").alias("driver"),
        F.expr(f"min_by(struct(value, now_n), struct(-now_n, value)) FILTER (WHERE dim_ord = {CLUSTER} AND now_n > 0)").alias("top"),
        F.expr(f"sum(now_n) FILTER (WHERE dim_ord = {CLUSTER})").alias("clustered"),
    )
    rank = 0.95 * (b - 1)
    at, part = int(rank), rank - int(rank)
    df = themes.withColumn("daily", F.expr(f"transform(sequence(0, {r + b - 1}), a -> coalesce(counts[a], 0L))"))
    df = df.withColumns({"recent": F.slice("daily", 1, r), "base": F.array_sort(F.slice("daily", r + 1, b))})
    df = df.withColumns({
        "recent_sum": F.expr("aggregate(recent, 0L, (s, n) -> s + n)"),
        "base_sum": F.expr("aggregate(base, 0L, (s, n) -> s + n)"),
        "base_squares": F.expr("aggregate(base, 0L, (s, n) -> s + n * n)"),
        "base_p95": F.expr(f"base[{at}] + (base[{min(at + 1, b - 1)}] - base[{at}]) * {part!r}D"),
    }).filter("base_sum > 0")
    df = df.withColumns({
        "recent_mean": F.expr(f"recent_sum / {r}D"),
        "base_mean": F.expr(f"base_sum / {b}D"),
        # from integer sums: the same on every run, and exactly 0 for a flat baseline
        "base_std": F.expr(f"sqrt((base_squares * {b} - base_sum * base_sum) / {b * (b - 1)}D)"),
        "onset_age": F.expr(
            f"array_max(filter(sequence(0, {r - 1}), a -> recent[a] > base_p95 AND recent[greatest(a - 1, 0)] > base_p95))"),
    })
    return df.selectExpr(
        "*", "recent_mean / base_mean AS lift",
        f"if(base_std = 0, 0D, try_divide(recent_mean - base_mean, base_std / sqrt({r}D))) AS z",
        f"(recent_mean - base_mean) * {r} AS extra",
    ).drop("counts", "daily", "recent", "base")


def rise_scores(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """Lift, z score and base 95th percentile of every theme with a baseline."""
    return rise_table(claims, rule, ()).select("theme", "recent_sum", "base_sum", "base_p95", "lift", "z")


def _day_back(age: int | str) -> str:
    return f"date_format(date_sub(last_day, {age}), 'yyyy-MM-dd')"


def emerging_onset(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """First recent day above the base 95th percentile that stays above it the next
    day; the last day is compared with itself. Null when there is none."""
    return rise_table(claims, rule, ()).selectExpr("theme", f"{_day_back('onset_age')} AS onset")


def _with_driver(df: DataFrame, rule: RiseRule) -> DataFrame:
    """Driver as columns. On a tie the earlier dimension wins, then the smaller
    value; only values seen in the recent weeks take part."""
    r, b = rule.recent, rule.baseline
    shown = round_to(df.selectExpr(
        "*", "driver.dimension AS driver_dimension", "driver.value AS driver_value",
        f"driver.before_n / {b}D AS driver_before", f"driver.now_n / {r}D AS driver_now",
        f"{share_sql('driver.gain', f'(recent_sum * {b} - base_sum * {r})')} AS share_of_rise",
    ), {"driver_before": 1, "driver_now": 1, "share_of_rise": 2})
    return shown.selectExpr(
        "*", "CASE WHEN share_of_rise >= 0.95 THEN 'nearly all' WHEN share_of_rise >= 0.6 THEN 'majority' "
        f"ELSE {percent_sql('share_of_rise')} END AS share_text")


def emerging_driver(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """The segment value with the largest gain per day, for every theme seen recently."""
    seen = rise_table(claims, rule).filter("driver IS NOT NULL")
    return _with_driver(seen, rule).select(
        "theme", "driver_dimension", "driver_value", "driver_before", "driver_now", "share_of_rise", "share_text")


def emerging_top_cluster(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """The cluster that holds most recent claims of each theme, and its share of
    the recent claims that have a cluster."""
    table = rise_table(claims, rule, ()).filter("top IS NOT NULL").selectExpr(
        "theme", "top.value AS top_cluster", f"{share_sql('top.now_n', 'clustered')} AS top_cluster_share")
    return round_to(table, {"top_cluster_share": 2})


def emerging(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """Rising themes with driver, onset, extra claims, top cluster and both windows."""
    found = rise_table(claims, rule).filter((F.col("lift") >= rule.min_lift) & (F.col("z") >= rule.min_z))
    labels = " ".join(f"WHEN '{name}' THEN '{label}'" for name, label in DIMENSION_LABELS.items())
    table = _with_driver(with_names(found), rule).selectExpr(
        "theme AS key", "name", "base_mean AS per_day_before", "recent_mean AS per_day_now", "lift", "z",
        f"{_day_back('onset_age')} AS onset",
        "cast(rint(extra) AS bigint) AS extra_claims",
        f"CASE driver_dimension {labels} END AS driver_dimension",
        "driver_value", "driver_before", "driver_now", "share_of_rise", "share_text",
        "top.value AS top_cluster", f"{share_sql('top.now_n', 'clustered')} AS top_cluster_share",
        f"{_day_back(rule.recent - 1)} AS recent_from", f"{_day_back(0)} AS recent_to",
        f"{_day_back(rule.needs_days - 1)} AS base_from", f"{_day_back(rule.recent)} AS base_to")
    digits = {"per_day_before": 1, "per_day_now": 1, "lift": 2, "z": 1, "top_cluster_share": 2}
    return round_to(table, digits).orderBy(F.desc("lift"), "key")
