"""Column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

DAY_SECONDS = 86_400


def sql_literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, str):
        assert "'" not in value and "\\" not in value, value
        return f"'{value}'"
    return repr(value)


def values_sql(rows: Iterable[tuple], columns: Mapping[str, str], alias: str = "t") -> str:
    """``SELECT ... FROM VALUES ...`` text for a constant table, in ANSI SQL."""
    body = ", ".join("(" + ", ".join(sql_literal(v) for v in row) + ")" for row in rows)
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {name}" for i, (name, kind) in enumerate(columns.items()))
    names = ", ".join(f"c{i}" for i in range(len(columns)))
    return f"SELECT {casts} FROM (VALUES {body}) AS {alias}({names})"


def inline_table(spark: SparkSession, rows: Iterable[tuple], columns: Mapping[str, str]) -> DataFrame:
    """A constant table as a local relation, so Catalyst knows its size."""
    return spark.sql(values_sql(rows, columns))


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where there is nothing to divide by."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def days(seconds: Column) -> Column:
    """Seconds as days. Sums are kept in whole seconds until this last step, so
    they are exact and do not depend on the order in which tasks finish."""
    return seconds / F.lit(float(DAY_SECONDS))


def nearest_sql(value: str, digits: int = 0) -> str:
    """SQL text that rounds to the nearest decimal, judged by the exact binary value,
    halves to even.

    ``round`` judges the printed digits instead and so turns 8.245 (stored a little
    below) into 8.25. Only where ``value * 10^digits`` lands on a half does the
    rounding error of that product decide; it is computed exactly by splitting the
    value into two parts of at most 26 bits."""
    x = f"cast({value} AS double)"
    if digits == 0:
        return f"rint({x})"
    p = f"{10**digits}D"
    t, high = f"({x} * {p})", f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    error = f"(({high} * {p} - {t}) + ({x} - {high}) * {p})"
    on_half = f"{t} - floor({t}) = 0.5D AND {error} <> 0D"
    return f"(CASE WHEN {on_half} THEN floor({t}) + if({error} > 0D, 1, 0) ELSE rint({t}) END / {p})"


def round_to(df: DataFrame, digits: Mapping[str, int]) -> DataFrame:
    """``df`` with the named columns rounded, in place."""
    return df.selectExpr(*(f"{nearest_sql(c, digits[c])} AS {c}" if c in digits else f"`{c}`" for c in df.columns))


def rounded(value: str, digits: int = 0) -> Column:
    """Column form of :func:`nearest_sql` for a named column."""
    return F.expr(nearest_sql(value, digits))


def rounded_by_product(value: Column, digits: int) -> Column:
    """Rounding as array libraries do it: scale, round half to even, scale back."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def share_sql(part: str, whole: str) -> str:
    """part / whole as SQL text, null where there is nothing to divide by."""
    return f"try_divide(cast({part} AS double), cast({whole} AS double))"


def mean_days_sql(seconds: str, where: str = "true") -> str:
    """Average in days of a seconds column over the chosen rows where it is present."""
    chosen = f"if({where}, {seconds}, NULL)"
    return share_sql(f"sum({chosen})", f"(count({chosen}) * {DAY_SECONDS})")


def percent_sql(share: str) -> str:
    return f"concat(cast(cast(rint({share} * 100) AS bigint) AS string), '%')"


def aggregates(texts: Mapping[str, str]) -> list[Column]:
    """Aggregate columns from SQL text by name."""
    return [F.expr(f"{text} AS `{name}`") for name, text in texts.items()]


def exclude_null(df: DataFrame, *names: str) -> DataFrame:
    """Rows whose group keys are all present: a missing key forms no group."""
    return df.dropna(subset=list(names))


def over_all() -> WindowSpec:
    """One window over a whole frame. Only for frames that are already aggregated
    to catalogue size (themes, stages, segment values)."""
    return Window.partitionBy(F.lit(0))
