"""Claims derived from the order tables.

Every order becomes a claim by fixed formulas on its keys, so the same table can
be stated in SQL. nation and region have 25 and 5 rows and are broadcast; the
customer and line-item sides grow with the orders and are left to Catalyst.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.config import AS_OF_LAG_DAYS, GENERIC_PEND_CODE, MIN_CONFIDENCE, NEEDS_REVIEW
from pendscope.functions.columns import sql_literal
from pendscope.operators.measures import add_measures
from pendscope.sources.playbook import STAGES, THEME_COLUMNS, THEMES
from pendscope.sources.tables import table

SUB_CAUSES = 2  # groups planted in every theme, and one more in every third
VAGUE_NOTE = "see file"


def _by_theme(number: str, values, kind: str) -> str:
    """Look a per-theme constant up by theme number; a folded array, so no join."""
    return f"element_at(cast(array({', '.join(map(sql_literal, values))}) AS array<{kind}>), cast({number} AS int) + 1)"


_T = [dict(zip(THEME_COLUMNS, row)) for row in THEMES]
_STAGE_NO = {row[0]: row[1] for row in STAGES}
_STAGE_OF = _by_theme("theme_no", [_STAGE_NO[t["stage"]] for t in _T], "int")
THEME_FACTS = (
    _by_theme("theme_no", [t["theme"] for t in _T], "string") + " AS theme_key",
    _by_theme("theme_no", [t["stage"] for t in _T], "string") + " AS theme_stage",
    _by_theme("theme_no", [t["theme_code"] for t in _T], "string") + " AS theme_code",
    _by_theme("theme_no", [t["theme_denial"] for t in _T], "string") + " AS theme_denial",
    f"{SUB_CAUSES} + int(theme_no % 3 = 0) AS sub_causes",
    _by_theme("if(k % 23 = 0, (theme_no + 1) % 13, theme_no)", [t["theme"] for t in _T], "string") + " AS guess",
)

# Stage ends and hold start in seconds since 1970. A held claim spends its hold
# inside the stage of its theme, so the hold delays that stage's end and all later ones.
_TO_INTAKE = "received_s + (k % 10 + 2 + if(channel = '5-LOW', 26, 0)) * 3600"
_TO_PREADJ = f"{_TO_INTAKE} + (c % 20 + 4) * 3600"
_TO_ADJUDICATION = f"{_TO_PREADJ} + ((k + c) % 48 + 24) * 3600"
_TO_FINAL = f"{_TO_ADJUDICATION} + (k % 24 + 12) * 3600"
TIMES = {
    "theme_no": "theme_no",
    "received_s": "received_s",
    "as_of_s": "as_of_s",
    "hold": "hold",
    "hold_from": f"CASE stage_no WHEN 0 THEN received_s WHEN 1 THEN {_TO_INTAKE} WHEN 2 THEN {_TO_PREADJ} ELSE {_TO_ADJUDICATION} END",
    "intake_end": f"{_TO_INTAKE} + if(stage_no = 0, hold, 0)",
    "preadj_end": f"{_TO_PREADJ} + if(stage_no <= 1, hold, 0)",
    "adjudication_end": f"{_TO_ADJUDICATION} + if(stage_no <= 2, hold, 0)",
    "final_end": f"{_TO_FINAL} + hold",
}
_TIME_COLUMNS = ("theme_no", "received_s", "as_of_s", "hold")

COLUMNS = (
    "concat('C26', lpad(cast(k AS string), 8, '0')) AS claim_id",
    "timestamp_seconds(received_s) AS received_ts",
    "received_date",
    *(f"if({end} <= as_of_s, timestamp_seconds({end}), NULL) AS {name}" for end, name in (
        ("intake_end", "intake_done_ts"), ("preadj_end", "preadj_done_ts"),
        ("adjudication_end", "adjudicated_ts"), ("final_end", "finalized_ts"))),
    "lob", "platform", "channel", "specialty", "network_status", "claim_type",
    "concat('P', cast(c AS string)) AS provider_id",
    "billed_amount",
    "CASE WHEN pended AND hold_from + hold > as_of_s THEN 'Pended' WHEN final_end > as_of_s THEN 'In process' "
    "WHEN pended AND theme_denial IS NOT NULL AND k % 4 = 0 THEN 'Denied' ELSE 'Paid' END AS status",
    "if(status = 'Denied', theme_denial, NULL) AS denial_code",
    "pended",
    "if(pended, timestamp_seconds(hold_from), NULL) AS pended_ts",
    "if(pended AND hold_from + hold <= as_of_s, timestamp_seconds(hold_from + hold), NULL) AS released_ts",
    "if(pended, theme_stage, NULL) AS pend_stage",
    f"if(pended AND k % 97 <> 0, if(k % 11 < 3, '{GENERIC_PEND_CODE}', theme_code), NULL) AS pend_code",
    f"if(pended AND k % 101 <> 0, if(k % 20 = 0, '{VAGUE_NOTE}', note), NULL) AS adjuster_note",
    "if(pended, cast(k % 4 + 1 AS int), 0) AS touches",
    "if(pended, theme_key, NULL) AS true_theme",
    "if(pended, concat(theme_key, ':', sub_cause), NULL) AS true_sub_cause",
    # Stand-in for the model output, stated as a rule.
    f"if(pended, if(confident, guess, '{NEEDS_REVIEW}'), NULL) AS theme",
    "if(pended, certainty / 100D, NULL) AS confidence",
    "if(pended AND confident, concat(guess, ':', if(k % 10 < 8, sub_cause, (sub_cause + 1) % sub_causes) + 1), NULL) "
    "AS cluster_id",
)


# A hold lasts up to four days by the cents of the order, times one to thirteen by theme.
HOLD = "(cast(billed_amount * 100 AS bigint) % 345600 + 7200) * (1 + theme_no * 5 % 13)"


def with_notes(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds ``note``: a line of a document, both chosen by the order's key. Only the keys of held orders look one up and the
    orders meet it by their key, so they are not moved to the documents; of the documents only numbered lines travel."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    lines = docs.filter("text IS NOT NULL").selectExpr("doc_id", "split(text, '\\n') AS lines").selectExpr(
        "doc_id", "size(lines) AS n_lines", "posexplode(lines) AS (line_no, note)")
    sizes = docs.filter("text IS NOT NULL").selectExpr("doc_id", "size(split(text, '\\n')) AS n_lines")
    asked = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' AND o_orderkey IS NOT NULL").selectExpr("o_orderkey AS asked").distinct()
    asked = asked.withColumn("n_docs", n_docs).withColumn("doc_id", F.expr("asked % n_docs")).drop("n_docs")
    asked = asked.join(sizes, "doc_id", "left").withColumn("line_no", F.expr("int(asked div 7 % n_lines)")).drop("n_lines")
    notes = asked.join(lines.drop("n_lines"), ["doc_id", "line_no"], "left").select("asked", "note")
    return df.join(notes, F.expr("k = asked AND held"), "left").drop("asked")


def claims_from_orders(spark: SparkSession, sf_dir: str, claim_type: bool = True, notes: bool = True) -> DataFrame:
    """Enriched claims with measures. ``claim_type`` costs a pass over the line items and ``notes`` one over the
    documents; leave them out where the operator does not read them (the note is then null)."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "cast(o_orderdate AS date) AS received_date", "o_orderstatus = 'P' AS held",
        "cast(o_totalprice AS decimal(12,2)) AS billed_amount", "o_orderpriority AS channel",
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
        .selectExpr("n_nationkey AS c_nationkey", "n_name AS specialty", "r_name AS platform")
    )
    customers = table(spark, sf_dir, "customer").join(F.broadcast(places), "c_nationkey").selectExpr(
        "c_custkey AS c", "c_mktsegment AS lob", "specialty", "platform",
        "if(c_acctbal >= 0, 'in network', 'out of network') AS network_status",
    )
    # customers grow with the orders; adaptive execution broadcasts a small table and splits a hot customer
    df = orders.join(customers, "c")
    if claim_type:
        lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n_lines"))
        df = df.join(lines, "k", "left").selectExpr(
            "*", "if(coalesce(n_lines, 0) >= 4, 'long form', 'short form') AS claim_type").drop("n_lines")
    df = with_notes(df, spark, sf_dir) if notes else df.withColumn("note", F.lit(None).cast("string"))

    last = orders.agg(F.max("received_date").alias("last_day")).scalar()
    as_of = F.date_add(last, AS_OF_LAG_DAYS)
    df = df.withColumn("as_of", as_of).selectExpr(
        "*",
        # the planted rise: one platform, last three weeks
        f"if(platform = 'EUROPE' AND received_date > as_of - {21 + AS_OF_LAG_DAYS}, 3, (k * 7 + c) % 13) AS theme_no",
        "unix_date(as_of) * 86400L AS as_of_s",
        "unix_date(received_date) * 86400L + (k * 37 % 1440) * 60 AS received_s",
        "k * 13 % 50 + 50 AS certainty",
        f"certainty >= {round(MIN_CONFIDENCE * 100)} AS confident",
    )
    df = df.selectExpr("*", f"{_STAGE_OF} AS stage_no", f"if(held, {HOLD}, 0) AS hold")
    # The times leave as the output of a generator, so that a filter on a derived
    # column is not rewritten into these formulas over and over.
    kept = [column for column in df.columns if column not in (*_TIME_COLUMNS, "stage_no", "as_of")]
    times = ", ".join(f"'{name}', {formula}" for name, formula in TIMES.items())
    df = df.selectExpr(*kept, f"inline(array(named_struct({times})))")
    df = df.selectExpr("*", *THEME_FACTS).selectExpr(
        "*", "held AND hold_from <= as_of_s AS pended", "(k div 3) % sub_causes AS sub_cause")
    columns = [column for column in COLUMNS if claim_type or column != "claim_type"]
    return add_measures(df.selectExpr(*columns), as_of)


def claims_of(spark: SparkSession, sf_dir: str, claim_type: bool = False, notes: bool = False) -> DataFrame:
    return claims_from_orders(spark, sf_dir, claim_type, notes)
