"""Dense daily series: one row per calendar day of the scope, zeros included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pendscope.config import STAGE_ORDER
from pendscope.functions.columns import exclude_null, rounded, share_sql


def _day_text(name: str = "received_date"):
    return F.date_format(name, "yyyy-MM-dd").alias("day")


def daily_overview(claims: DataFrame) -> DataFrame:
    """Received and pended per day; the rate is null on a day without claims."""
    counts = exclude_null(claims, "received_date").groupBy("received_date").agg(
        F.count("*").alias("received"), F.count_if("pended").alias("pended"))
    return fill_overview(counts)


def fill_overview(counts: DataFrame) -> DataFrame:
    """Every day from the first to the last of ``counts`` (received_date, received, pended)."""
    bounds = counts.agg(F.min("received_date").alias("lo"), F.max("received_date").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi")).alias("received_date"))
    filled = spine.join(counts, "received_date", "left").fillna(0, ["received", "pended"])
    return filled.orderBy("received_date").select(
        _day_text(), "received", "pended", rounded(f"{share_sql('pended', 'received')} * 100", 2).alias("pended_rate"))


def _day_counts(claims: DataFrame, key: str) -> DataFrame:
    held = F.expr(f"if(pended, {key}, NULL)").alias("key")
    return exclude_null(claims, "received_date").groupBy("received_date", held).agg(F.count("*").alias("n"))


def fill_days(counts: DataFrame) -> DataFrame:
    """Every key on every day between the first and the last day of all rows, in one pass over the counts. They are one row per
    day and key, so a key's days are a map in one row."""
    everywhere = Window.partitionBy()
    bounded = counts.select("key", "received_date", "n", F.min("received_date").over(everywhere).alias("lo"), F.max("received_date").over(everywhere).alias("hi"))
    by_key = exclude_null(bounded, "key").groupBy("key", "lo", "hi").agg(
        F.expr("map_from_entries(array_compact(collect_list(if(received_date IS NULL, NULL, struct(received_date, n)))))").alias("days"))
    filled = by_key.withColumn("received_date", F.explode(F.sequence("lo", "hi")))
    return (
        filled.select("key", "received_date", F.expr("coalesce(days[received_date], 0L)").alias("pended"))
        .orderBy("key", "received_date").select(_day_text(), "key", "pended")
    )


def daily_by_theme(claims: DataFrame) -> DataFrame:
    """Pended claims per day for every theme seen in the scope."""
    return fill_days(_day_counts(claims, "theme"))


def daily_by_stage(claims: DataFrame) -> DataFrame:
    """Pended claims per day for each of the four stages, also for one without any."""
    stages = claims.sparkSession.range(1).select(
        F.lit(None).cast("date").alias("received_date"), F.explode(F.array(*map(F.lit, STAGE_ORDER))).alias("key"), F.lit(0).cast("long").alias("n"))
    return fill_days(_day_counts(claims, "pend_stage").unionByName(stages))
