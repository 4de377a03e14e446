"""How often each segment of claims is held up, and by which theme."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pendscope.config import SEGMENT_DIMENSIONS
from pendscope.functions.columns import exclude_null, over_all, round_to, share_sql
from pendscope.operators.themes import with_names


def _dimension(name: str) -> str:
    if name not in SEGMENT_DIMENSIONS:
        raise ValueError(f"dimension must be one of {', '.join(SEGMENT_DIMENSIONS)}, not {name!r}")
    return name


def segment_counts(claims: DataFrame, dimensions: Sequence[str] = SEGMENT_DIMENSIONS) -> DataFrame:
    """(dim_ord, dimension, value, theme, n); theme is null for claims not held.

    Claims are first counted per combination of all dimensions, in one pass; only
    those few combinations are laid out per dimension. ``dim_ord`` -1 is the whole scope."""
    theme = F.expr("if(pended, theme, NULL)").alias("theme")
    return lay_out(claims.groupBy(theme, *map(_dimension, dimensions)).agg(F.count("*").alias("n")), dimensions)


def lay_out(combos: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """:func:`segment_counts` from the counted combinations of theme and dimensions."""
    layout = [f"named_struct('dim_ord', {i}, 'dimension', '{d}', 'value', cast({d} AS string))" for i, d in enumerate(dimensions)]
    whole = "named_struct('dim_ord', -1, 'dimension', '', 'value', '')"
    long = combos.selectExpr("theme", "n", f"inline(array({', '.join([whole, *layout])}))")
    return exclude_null(long, "value").groupBy("dim_ord", "dimension", "value", "theme").agg(F.sum("n").alias("n"))


def segment_rates(claims: DataFrame, dimensions: Sequence[str] = SEGMENT_DIMENSIONS, theme: str | None = None) -> DataFrame:
    """Held claims per 1,000 received for every theme and segment value, with the
    index against the theme's overall rate. Values never hit by a theme show zero."""
    return rates_of(segment_counts(claims, dimensions), theme)


def rates_of(counts: DataFrame, theme: str | None = None) -> DataFrame:
    """:func:`segment_rates` from :func:`segment_counts`."""
    hit = F.when(F.col("theme").isNotNull(), F.struct("theme", "n"))
    values = counts.groupBy("dim_ord", "dimension", "value").agg(
        F.sum("n").alias("received"), F.map_from_entries(F.array_compact(F.collect_list(hit))).alias("hits"))
    whole = F.col("dim_ord") == -1
    values = values.withColumns({
        "all_hits": F.first(F.when(whole, F.col("hits")), ignorenulls=True).over(over_all()),
        "all_received": F.max(F.when(whole, F.col("received"))).over(over_all()),
    }).filter(~whole)
    rates = values.select(
        "dim_ord", "dimension", "value", F.col("received").alias("claims_received"), "hits", "all_received",
        F.explode("all_hits").alias("theme", "in_theme"),
    ).withColumn("pended", F.coalesce(F.col("hits")[F.col("theme")], F.lit(0)))
    if theme is not None:
        rates = rates.filter(F.col("theme") == theme)
    per_1000 = f"{share_sql('pended', 'claims_received')} * 1000"
    overall = f"({share_sql('in_theme', 'all_received')} * 1000)"
    return round_to(rates.selectExpr(
        "theme", "dim_ord", "dimension", "value", "claims_received", "pended", "in_theme",
        f"{per_1000} AS per_1000", f"try_divide({per_1000}, {overall}) AS index"), {"per_1000": 1, "index": 2})


def theme_segments(claims: DataFrame, dimensions: Sequence[str] = SEGMENT_DIMENSIONS, theme: str | None = None) -> DataFrame:
    """Segment rates as reported, highest rate first within theme and dimension."""
    return segment_table(segment_counts(claims, dimensions), theme)


def segment_table(counts: DataFrame, theme: str | None = None) -> DataFrame:
    return (
        rates_of(counts, theme)
        .orderBy("theme", "dim_ord", F.desc("per_1000"), "value")
        .select("theme", "dimension", "value", "claims_received", "pended", "per_1000", "index")
    )


def most_affected(claims: DataFrame, k: int = 2) -> DataFrame:
    """The k most affected values per theme and dimension; ``hottest`` marks the
    leading value with the highest index over all dimensions of the theme."""
    rates = segment_rates(claims)
    in_dimension = Window.partitionBy("theme", "dim_ord").orderBy(F.desc("per_1000"), "value")
    leaders = rates.withColumn("position", F.row_number().over(in_dimension)).filter(F.col("position") <= k)
    across = Window.partitionBy("theme").orderBy("position", F.desc(F.coalesce("index", F.lit(0.0))), "dim_ord")
    return leaders.withColumn("hottest", F.row_number().over(across) == 1).select(
        "theme", "dimension", "position", "value", "per_1000", "index", "hottest")


def hotspots(claims: DataFrame, dimension: str = "platform", levels: int = 7) -> DataFrame:
    """Theme by segment matrix in long form, with a heat level per cell."""
    cells = segment_rates(claims, [dimension])
    top = F.greatest(F.max(F.coalesce("per_1000", F.lit(0.0))).over(over_all()), F.lit(1e-9))
    heat = F.least(F.floor(F.coalesce("per_1000", F.lit(0.0)) / top * (levels - 0.001)), F.lit(levels - 1))
    return (
        with_names(cells.withColumn("heat", heat.cast("int")))
        .orderBy(F.desc("in_theme"), "theme", "value")
        .select(F.col("theme").alias("key"), "name", "value", F.col("claims_received").alias("received"),
                F.col("pended").alias("claims"), "per_1000", "heat")
    )


def segment_totals(claims: DataFrame, dimension: str = "platform") -> DataFrame:
    """Overall rate per segment value and the theme that hits it hardest."""
    cells = segment_rates(claims, [dimension])
    worst = F.min_by(F.struct("theme", "per_1000"), F.struct(-F.col("per_1000"), -F.col("in_theme"), F.col("theme")))
    totals = cells.groupBy("value", "claims_received").agg(F.sum("pended").alias("pended"), worst.alias("worst"))
    return (
        round_to(totals.selectExpr(
            "value", "claims_received", "pended", f"{share_sql('pended', 'claims_received')} * 1000 AS per_1000",
            "worst.theme AS worst_theme", "worst.per_1000 AS worst_per_1000"), {"per_1000": 1})
        .orderBy(F.desc("per_1000"), "value")
    )
