"""The claims table and the catalogues as common table expressions."""

from __future__ import annotations

import re

from pendscope.config import STAGE_ORDER
from pendscope.functions.columns import values_sql
from pendscope.sources.adapter import SUB_CAUSES, VAGUE_NOTE
from pendscope.sources.playbook import EFFORT_COLUMNS, EFFORTS, REVIEW, STAGE_COLUMNS, STAGES, THEME_COLUMNS, THEMES


def _values(rows, columns) -> str:
    return values_sql(rows, {name: "varchar" if kind == "string" else kind for name, kind in columns.items()})


DIMS = f"""
stage_dim AS ({_values(STAGES, STAGE_COLUMNS)}),
effort_dim AS ({_values(EFFORTS, EFFORT_COLUMNS)}),
playbook AS ({_values(THEMES, THEME_COLUMNS)}),
theme_dim AS (
  SELECT t.*, s.stage_ord, s.stage_name
  FROM ({_values(THEMES + (REVIEW,), THEME_COLUMNS)}) t LEFT JOIN stage_dim s ON t.stage = s.stage)"""

CLAIMS = f"""{DIMS},
edge AS (SELECT CAST(max(o_orderdate) AS DATE) AS last_day FROM orders),
line_counts AS (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey),
c0 AS (
  SELECT o.o_orderkey AS k, o.o_custkey AS c, CAST(o.o_orderdate AS DATE) AS received_date,
    o.o_orderstatus = 'P' AS held, CAST(o.o_totalprice AS DECIMAL(12,2)) AS billed_amount,
    o.o_orderpriority AS channel, cu.c_mktsegment AS lob, n.n_name AS specialty, r.r_name AS platform,
    CASE WHEN cu.c_acctbal >= 0 THEN 'in network' ELSE 'out of network' END AS network_status,
    CASE WHEN coalesce(l.n_lines, 0) >= 4 THEN 'long form' ELSE 'short form' END AS claim_type,
    e.last_day, e.last_day + 2 AS as_of, (e.last_day + 2 - DATE '1970-01-01') * 86400 AS as_of_s,
    CASE WHEN r.r_name = 'EUROPE' AND CAST(o.o_orderdate AS DATE) > e.last_day - 21 THEN 3
         ELSE (o.o_orderkey * 7 + o.o_custkey) % 13 END AS true_ord
  FROM orders o JOIN customer cu ON o.o_custkey = cu.c_custkey
  JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN line_counts l ON l.l_orderkey = o.o_orderkey CROSS JOIN edge e),
c1 AS (
  SELECT c0.*, t.theme AS ttheme, t.stage AS tstage, s.stage_ord AS so, t.theme_code, t.theme_denial,
    {SUB_CAUSES} + CASE WHEN true_ord % 3 = 0 THEN 1 ELSE 0 END AS sub_causes,
    CASE WHEN held THEN (CAST(billed_amount * 100 AS BIGINT) % 345600 + 7200) * (1 + true_ord * 5 % 13) ELSE 0 END AS hold,
    (received_date - DATE '1970-01-01') * 86400 + (k * 37 % 1440) * 60 AS t0,
    (k // 3) % ({SUB_CAUSES} + CASE WHEN true_ord % 3 = 0 THEN 1 ELSE 0 END) AS sub_cause
  FROM c0 JOIN playbook t ON t.theme_ord = true_ord JOIN stage_dim s ON s.stage = t.stage),
c2 AS (SELECT *, t0 + (k % 10 + 2 + CASE WHEN channel = '5-LOW' THEN 26 ELSE 0 END) * 3600
  + CASE WHEN so = 0 THEN hold ELSE 0 END AS t1 FROM c1),
c3 AS (SELECT *, t1 + (c % 20 + 4) * 3600 + CASE WHEN so = 1 THEN hold ELSE 0 END AS t2 FROM c2),
c4 AS (SELECT *, t2 + ((k + c) % 48 + 24) * 3600 + CASE WHEN so = 2 THEN hold ELSE 0 END AS t3 FROM c3),
c5 AS (SELECT *, t3 + (k % 24 + 12) * 3600 + CASE WHEN so = 3 THEN hold ELSE 0 END AS t4,
  CASE so WHEN 0 THEN t0 WHEN 1 THEN t1 WHEN 2 THEN t2 ELSE t3 END AS hold_from FROM c4),
c6 AS (SELECT *, held AND hold_from <= as_of_s AS pended FROM c5),
c7 AS (
  SELECT c6.*, 'C26' || lpad(CAST(k AS VARCHAR), 8, '0') AS claim_id, 'P' || CAST(c AS VARCHAR) AS provider_id,
    t0 AS received_at,
    CASE WHEN t1 <= as_of_s THEN t1 END AS intake_done_at, CASE WHEN t2 <= as_of_s THEN t2 END AS preadj_done_at,
    CASE WHEN t3 <= as_of_s THEN t3 END AS adjudicated_at, CASE WHEN t4 <= as_of_s THEN t4 END AS finalized_at,
    CASE WHEN pended THEN hold_from END AS pended_at,
    CASE WHEN pended AND hold_from + hold <= as_of_s THEN hold_from + hold END AS released_at,
    CASE WHEN pended THEN tstage END AS pend_stage,
    CASE WHEN pended AND k % 97 <> 0 THEN CASE WHEN k % 11 < 3 THEN 'PND-000' ELSE theme_code END END AS pend_code,
    CASE WHEN pended THEN k % 4 + 1 ELSE 0 END AS touches,
    CASE WHEN pended THEN ttheme END AS true_theme,
    CASE WHEN pended THEN ttheme || ':' || sub_cause END AS true_sub_cause,
    CASE WHEN pended THEN CASE WHEN k % 23 = 0 THEN (true_ord + 1) % 13 ELSE true_ord END END AS guess_ord,
    CASE WHEN pended THEN (k * 13 % 50 + 50) / 100 END AS confidence
  FROM c6),
c8 AS (
  SELECT c7.*, 
    CASE WHEN pended AND released_at IS NULL THEN 'Pended' WHEN finalized_at IS NULL THEN 'In process'
         WHEN pended AND c7.theme_denial IS NOT NULL AND k % 4 = 0 THEN 'Denied' ELSE 'Paid' END AS status,
    CASE WHEN pended AND k % 101 <> 0 THEN CASE WHEN k % 20 = 0 THEN '{VAGUE_NOTE}'
         ELSE string_split(n.text, chr(10))[CAST(k // 7 % len(string_split(n.text, chr(10))) AS INTEGER) + 1] END END AS adjuster_note,
    CASE WHEN confidence >= 0.55 THEN g.theme WHEN pended THEN 'needs_review' END AS theme,
    CASE WHEN k % 10 < 8 THEN sub_cause ELSE (sub_cause + 1) % c7.sub_causes END + 1 AS cluster_rank
  FROM c7 LEFT JOIN playbook g ON g.theme_ord = c7.guess_ord
  LEFT JOIN documents n ON c7.pended AND n.doc_id = c7.k % (SELECT count(*) FROM documents)),
claims AS (
  SELECT *, CASE WHEN status = 'Denied' THEN theme_denial END AS denial_code,
    CASE WHEN theme <> 'needs_review' THEN theme || ':' || cluster_rank END AS cluster_id,
    CASE WHEN pended THEN coalesce(released_at, as_of_s) - pended_at END AS pend_s,
    finalized_at - received_at AS tat_s, coalesce(finalized_at, as_of_s) - received_at AS age_s,
    intake_done_at - received_at AS intake_s, preadj_done_at - intake_done_at AS pre_adjudication_s,
    adjudicated_at - preadj_done_at AS adjudication_s, finalized_at - adjudicated_at AS post_adjudication_s,
    finalized_at IS NULL AS is_open, coalesce(finalized_at, as_of_s) - received_at > 30 * 86400 AS over_target
  FROM c8)"""

STAGE_CASES = " ".join(f"WHEN '{stage}' THEN {i}" for i, stage in enumerate(STAGE_ORDER))


def nearest(sql: str) -> str:
    """Rewrites ``round(x, n)`` to print and reread, which rounds the exact binary
    value to the nearest decimal with halves to even."""
    out, rest = "", sql
    while (match := re.search(r"\bround\(", rest)) is not None:
        out += rest[: match.start()]
        depth, end, comma = 1, match.end(), None
        while depth:
            if rest[end] == "," and depth == 1:
                comma = end
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        inner, digits = rest[match.end(): comma or end - 1], rest[comma + 1 : end - 1].strip() if comma else "0"
        out += f"CAST(printf('%.{digits}f', CAST({nearest(inner)} AS DOUBLE)) AS DOUBLE)"
        rest = rest[end:]
    return out + rest


def with_claims(body: str, *extra: str) -> str:
    """``WITH <claims>, <extra...> <body>``"""
    parts = ",\n".join((CLAIMS, *extra))
    return nearest(f"WITH {parts}\n{body}")


def day_text(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def share(part: str, whole: str, digits: int) -> str:
    return f"round(CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0), {digits})"


def mean_days(seconds: str, digits: int, where: str = "") -> str:
    only = f" FILTER (WHERE {where})" if where else ""
    return (f"round(CAST(sum({seconds}){only} AS DOUBLE) / nullif(CAST(count({seconds}){only} * 86400 AS DOUBLE), 0), "
            f"{digits})")
