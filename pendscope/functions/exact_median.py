"""Exact quantiles per group without gathering a group in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer.
Here the values are counted first (copies collapse before the shuffle), a coarse
histogram finds the one or two buckets that hold the wanted rank, and only those
buckets are ordered. Values are whole seconds, so a day bucket has at most 86,400
distinct values whatever the volume."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pendscope.functions.columns import DAY_SECONDS


def exact_quantile(df: DataFrame, key: str, value: str, q: float = 0.5, width: int = DAY_SECONDS) -> DataFrame:
    """(``key``, ``quantile``) with linear interpolation between neighbours.

    ``key`` is a catalogue column (themes), so the rank table that is broadcast has
    at most two rows per catalogue entry."""
    return counted_quantile(df.groupBy(key, value).agg(F.count("*").alias("n")), key, value, q, width)


def counted_quantile(counts: DataFrame, key: str, value: str, q: float = 0.5, width: int = DAY_SECONDS) -> DataFrame:
    """:func:`exact_quantile` of values that are counted already (``key``, ``value``, n)."""
    counts = counts.filter(F.col(value).isNotNull()).withColumn("bucket", F.floor(F.col(value) / width))

    in_order = Window.partitionBy(key).orderBy("bucket")
    ranked = (
        counts.groupBy(key, "bucket").agg(F.sum("n").alias("n"))
        .withColumns({
            "upto": F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "total": F.sum("n").over(Window.partitionBy(key)),
        })
        .withColumn("rank", F.lit(q) * (F.col("total") - 1))
        .selectExpr(key, "bucket", "upto - n AS base", "upto", "floor(rank) AS lo", "ceil(rank) AS hi", "rank - floor(rank) AS part")
        .filter("(base <= lo AND lo < upto) OR (base <= hi AND hi < upto)")
        .drop("upto")
    )
    within = Window.partitionBy(key, "bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    values = (
        counts.join(F.broadcast(ranked), [key, "bucket"])
        .withColumn("last", F.col("base") + F.sum("n").over(within))
        .withColumn("first", F.col("last") - F.col("n"))
    )

    def at(rank: str):
        return F.max(F.when((F.col("first") <= F.col(rank)) & (F.col(rank) < F.col("last")), F.col(value)))

    return (
        values.groupBy(key)
        .agg(at("lo").alias("below"), at("hi").alias("above"), F.max("part").alias("part"))
        .selectExpr(key, "below + (above - below) * part AS quantile")
    )
