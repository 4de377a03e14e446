"""The few points worth telling, as typed figures; their wording is left to whoever shows them."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pendscope.config import NEEDS_REVIEW
from pendscope.functions.columns import aggregates
from pendscope.operators.emerging import RiseRule, emerging
from pendscope.operators.themes import theme_figures

ROW = "struct(theme, claims, claims_share, avg_pend_days, pend_days, pend_days_share)"
FIELDS = {
    "seq": "int", "kind": "string", "theme": "string", "claims": "bigint", "claims_share": "double", "avg_days": "double", "days": "double",
    "days_share": "double", "per_day_before": "double", "per_day_now": "double", "onset": "string", "driver_dimension": "string",
    "driver_value": "string", "driver_share": "double", "generic_share": "double",
}


def _finding(seq: int, kind: str, **values: str) -> str:
    """A finding as a struct in SQL text; what is not given is null."""
    given = {"seq": str(seq), "kind": f"'{kind}'", **values}
    return "named_struct(" + ", ".join(f"'{name}', cast({given.get(name, 'NULL')} AS {of})" for name, of in FIELDS.items()) + ")"


def _figures(row: str) -> dict[str, str]:
    return {"theme": f"{row}.theme", "claims": f"{row}.claims", "claims_share": f"{row}.claims_share", "avg_days": f"{row}.avg_pend_days",
            "days": f"{row}.pend_days", "days_share": f"{row}.pend_days_share"}


# The theme with most days lost; the quickest theme where its share of claims is over twice its share of days, else the theme
# with most claims where it is not the first one; and how much the general code hides.
IMPACT = _finding(1, "impact", **_figures("d"))
CONTRAST = (f"CASE WHEN q.claims_share > q.pend_days_share * 2 THEN {_finding(2, 'frequent_but_quick', **_figures('q'))} "
            f"WHEN c.theme <> d.theme THEN {_finding(2, 'frequent_not_costly', **_figures('c'))} END")
HIDDEN = _finding(4, "visibility", generic_share="generic_share")
RISE = _finding(3, "emerging", theme="key", per_day_before="per_day_before", per_day_now="per_day_now", onset="onset",
                driver_dimension="driver_dimension", driver_value="driver_value", driver_share="share_of_rise")


def _leaders(claims: DataFrame) -> DataFrame:
    """One row: the theme with most days (d), most claims (c) and the shortest
    average hold (q). Ties go to the theme with more days lost, then by key."""
    first = "min_by({row}, struct({order}-pend_days, theme)) FILTER (WHERE theme <> '" + NEEDS_REVIEW + "')"
    return theme_figures(claims).agg(*aggregates({
        "d": first.format(row=ROW, order=""),
        "c": first.format(row=ROW, order="-claims, "),
        "q": first.format(row=ROW, order="avg_pend_days, "),
        "generic_share": "max(generic_share)",
    })).filter("d IS NOT NULL")


def key_findings(claims: DataFrame, rule: RiseRule = RiseRule()) -> DataFrame:
    """Impact, contrast, rise and visibility; each is present only when its rule holds, and none of them in a scope
    without a named theme."""
    leaders = _leaders(claims)
    told = leaders.selectExpr(f"inline(array_compact(array({IMPACT}, {CONTRAST}, {HIDDEN})))")
    rise = claims.sparkSession.sql("SELECT * FROM {rise} WHERE EXISTS (SELECT 1 FROM {leaders})",
                                   rise=emerging(claims, rule).limit(1), leaders=leaders.select("generic_share"))
    return told.unionByName(rise.selectExpr(f"inline(array({RISE}))")).orderBy("seq")
