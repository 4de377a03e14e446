"""Derived measures: durations in whole seconds and days, and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pendscope.config import AS_OF_LAG_DAYS, SLA_DAYS
from pendscope.functions.columns import DAY_SECONDS, days

STAGE_BOUNDS = {
    "intake": ("received_ts", "intake_done_ts"),
    "pre_adjudication": ("intake_done_ts", "preadj_done_ts"),
    "adjudication": ("preadj_done_ts", "adjudicated_ts"),
    "post_adjudication": ("adjudicated_ts", "finalized_ts"),
}


def _seconds(start: Column, end: Column) -> Column:
    return F.unix_seconds(end) - F.unix_seconds(start)


def as_of_day(claims: DataFrame) -> Column:
    """Reporting day: two days after the last receipt, as a scalar subquery."""
    last = claims.agg(F.max("received_date").alias("last_day")).scalar()
    return F.date_add(last, AS_OF_LAG_DAYS)


def add_measures(claims: DataFrame, as_of: Column | None = None, sla_days: int = SLA_DAYS) -> DataFrame:
    """Claims with ``is_open``, ``over_target`` and every duration.

    A claim still held counts until ``as_of``. Stage durations are null where the
    stage was not finished. Each duration comes in seconds (exact, used for all
    sums) and in days."""
    if "received_date" not in claims.columns:
        claims = claims.withColumn("received_date", F.to_date("received_ts"))
    now = (as_of_day(claims) if as_of is None else as_of).cast("timestamp")
    c = F.col
    seconds = {
        "pend": F.when(c("pended"), _seconds(c("pended_ts"), F.coalesce(c("released_ts"), now))),
        "tat": _seconds(c("received_ts"), c("finalized_ts")),
        "age": _seconds(c("received_ts"), F.coalesce(c("finalized_ts"), now)),
    }
    for stage, (start, end) in STAGE_BOUNDS.items():
        seconds[stage] = _seconds(c(start), c(end))
    df = claims.withColumns({f"{name}_s": value for name, value in seconds.items()})
    in_days = {f"{name}_days": days(c(f"{name}_s")) for name in ("pend", "tat", "age")}
    in_days |= {f"days_{stage}": days(c(f"{stage}_s")) for stage in STAGE_BOUNDS}
    return df.withColumns(
        in_days
        | {
            "is_open": c("finalized_ts").isNull(),
            "over_target": c("age_s") > F.lit(sla_days * DAY_SECONDS),
        }
    )
