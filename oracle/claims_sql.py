"""SQL twins of the queries over the claims table."""

from __future__ import annotations

from oracle.base import STAGE_CASES, day_text, mean_days, share, with_claims
from pendscope.config import SEGMENT_DIMENSIONS, STAGE_ORDER

PENDED = "pended AS MATERIALIZED (SELECT * FROM claims WHERE pended)"

TOTALS = """totals AS (SELECT count(*) AS all_claims, CAST(sum(pend_s) AS DOUBLE) AS all_s,
  count(*) FILTER (WHERE pend_code = 'PND-000') AS all_generic FROM pended)"""

FIGURES = f"""figures AS (
  SELECT p.theme AS key, any_value(d.theme_name) AS name, any_value(d.stage) AS stage, any_value(d.stage_name) AS stage_name,
    any_value(d.stage_ord) AS stage_ord,
    count(*) AS claims, round(count(*) / any_value(t.all_claims), 4) AS claims_share,
    {mean_days('pend_s', 1)} AS avg_pend_days, round(median(pend_s) / 86400, 1) AS median_pend_days,
    round(CAST(sum(pend_s) AS DOUBLE) / 86400, 0) AS pend_days,
    round(CAST(sum(pend_s) AS DOUBLE) / any_value(t.all_s), 4) AS pend_days_share,
    CAST(round(sum(billed_amount), 0) AS DOUBLE) AS billed, CAST(sum(touches) AS BIGINT) AS touches,
    count(*) FILTER (WHERE over_target) AS over_target, count(*) FILTER (WHERE released_at IS NULL) AS open,
    round(count(*) FILTER (WHERE status = 'Denied') / count(*), 4) AS denied_share,
    round(any_value(t.all_generic) / any_value(t.all_claims), 4) AS generic_share
  FROM pended p CROSS JOIN totals t LEFT JOIN theme_dim d ON d.theme = p.theme
  WHERE p.theme IS NOT NULL GROUP BY p.theme)"""

THEME_COLUMNS = ("key, name, stage, stage_name, claims, claims_share, avg_pend_days, median_pend_days, pend_days, "
                 "pend_days_share, billed, touches, over_target, open, denied_share")

ADVICE = """advice AS (SELECT theme, n_name AS owner, 'plain ' || n_nationkey AS plain, 'why ' || n_regionkey AS why, lower(n_name) AS intervention
  FROM nation JOIN playbook ON theme_ord = n_nationkey)"""

PLAN = ADVICE + """,
plan AS (
  SELECT f.*, b.addressability, e.effort, b.effort_level, a.intervention, a.owner, a.why,
    round(f.pend_days * b.addressability, 0) AS recoverable_days,
    CAST(round(f.claims * b.addressability) AS BIGINT) AS recoverable_claims,
    CAST(round(f.touches * b.addressability) AS BIGINT) AS recoverable_touches,
    round(f.pend_days * b.addressability / e.effort_weight, 0) AS priority_score
  FROM figures f JOIN playbook b ON b.theme = f.key JOIN effort_dim e ON e.effort_level = b.effort_level LEFT JOIN advice a ON a.theme = f.key),
ranked AS (SELECT *, row_number() OVER (ORDER BY priority_score DESC, pend_days DESC, key) AS rank FROM plan)"""

BASIS = """basis AS (
  SELECT greatest(count(DISTINCT received_date), 1) AS days_in_window, count(*) AS claims_in_window,
    CAST(round(count(*) * 365 / greatest(count(DISTINCT received_date), 1)) AS BIGINT) AS claims_per_year FROM claims)"""


def _long(dimensions=SEGMENT_DIMENSIONS, source: str = "claims") -> str:
    return "segments AS (" + " UNION ALL ".join(
        f"SELECT {i} AS dim_ord, '{d}' AS dimension, {d} AS value, theme, pended, received_date FROM {source} WHERE {d} IS NOT NULL"
        for i, d in enumerate(dimensions)) + ")"


RATES = """received AS (SELECT dim_ord, dimension, value, count(*) AS claims_received FROM segments GROUP BY ALL),
hits AS (SELECT dim_ord, value, theme, count(*) AS n FROM segments WHERE pended AND theme IS NOT NULL GROUP BY ALL),
in_theme AS (SELECT theme, count(*) AS in_theme FROM pended WHERE theme IS NOT NULL GROUP BY theme),
n_claims AS (SELECT count(*) AS n_claims FROM claims),
rates AS (
  SELECT i.theme, r.dim_ord, r.dimension, r.value, r.claims_received, coalesce(h.n, 0) AS pended, i.in_theme,
    round(coalesce(h.n, 0) / r.claims_received * 1000, 1) AS per_1000,
    round((coalesce(h.n, 0) / r.claims_received * 1000) / (i.in_theme / n_claims * 1000), 2) AS index
  FROM received r CROSS JOIN in_theme i CROSS JOIN n_claims
  LEFT JOIN hits h ON h.dim_ord = r.dim_ord AND h.value = r.value AND h.theme = i.theme)"""

SEGMENT_SELECT = "SELECT theme, dimension, value, claims_received, pended, per_1000, index FROM rates"

WINDOW = """span AS (SELECT min(received_date) AS first_day, max(received_date) AS last_day FROM claims),
recent63 AS (
  SELECT p.*, s.last_day - p.received_date AS age, s.last_day AS scope_last FROM pended p CROSS JOIN span s
  WHERE p.theme IS NOT NULL AND p.received_date > s.last_day - 63 AND s.last_day - s.first_day + 1 >= 63),
dense AS (
  SELECT t.theme, t.scope_last, a.age, t.scope_last - CAST(a.age AS INTEGER) AS day, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT theme, scope_last FROM recent63) t CROSS JOIN range(63) a(age)
  LEFT JOIN (SELECT theme, age, count(*) AS n FROM recent63 GROUP BY ALL) c ON c.theme = t.theme AND c.age = a.age),
sums AS (
  SELECT theme, any_value(scope_last) AS last_day, sum(n) FILTER (WHERE age < 21) AS recent_sum,
    sum(n) FILTER (WHERE age >= 21) AS base_sum, sum(n * n) FILTER (WHERE age >= 21) AS base_squares,
    quantile_cont(n, 0.95) FILTER (WHERE age >= 21) AS base_p95
  FROM dense GROUP BY theme),
scores AS (
  SELECT *, recent_sum / 21 AS recent_mean, base_sum / 42 AS base_mean,
    (recent_sum / 21) / (base_sum / 42) AS lift,
    CASE WHEN base_squares * 42 = base_sum * base_sum THEN 0
         ELSE (recent_sum / 21 - base_sum / 42) / (sqrt((base_squares * 42 - base_sum * base_sum) / 1722) / sqrt(21)) END AS z
  FROM sums WHERE base_sum > 0),
found AS (SELECT * FROM scores WHERE lift >= 1.4 AND z >= 3.0)"""

DRIVER = "segs AS (" + " UNION ALL ".join(
    f"SELECT {i} AS dim_ord, '{d}' AS dimension, {d} AS value, theme, age FROM recent63" for i, d in enumerate(SEGMENT_DIMENSIONS)
) + """),
gains AS (
  SELECT theme, dim_ord, dimension, value, count(*) FILTER (WHERE age < 21) AS now_n, count(*) FILTER (WHERE age >= 21) AS before_n
  FROM segs GROUP BY ALL),
driver AS (
  SELECT g.theme, dimension AS driver_dimension, value AS driver_value, round(before_n / 42, 1) AS driver_before,
    round(now_n / 21, 1) AS driver_now,
    round((now_n * 42 - before_n * 21) / nullif(s.recent_sum * 42 - s.base_sum * 21, 0), 2) AS share_of_rise
  FROM gains g JOIN {scores} s ON s.theme = g.theme WHERE now_n > 0
  QUALIFY row_number() OVER (PARTITION BY g.theme ORDER BY now_n * 42 - before_n * 21 DESC, dim_ord, value) = 1),
driver_text AS (
  SELECT *, CASE WHEN share_of_rise >= 0.95 THEN 'nearly all' WHEN share_of_rise >= 0.6 THEN 'majority'
    ELSE CAST(round(share_of_rise * 100) AS BIGINT) || '%' END AS share_text FROM driver)"""

ONSET = """nexts AS (
  SELECT d.*, s.base_p95, coalesce(lead(n) OVER (PARTITION BY d.theme ORDER BY day), n) AS next
  FROM dense d JOIN {scores} s ON s.theme = d.theme WHERE age < 21),
onset AS (
  SELECT theme, strftime(min(day) FILTER (WHERE n > base_p95 AND next > base_p95), '%Y-%m-%d') AS onset
  FROM nexts GROUP BY theme)"""

TOP_CLUSTER = """top_cluster AS (
  SELECT theme, cluster_id AS top_cluster, round(count(*) / sum(count(*)) OVER (PARTITION BY theme), 2) AS top_cluster_share
  FROM recent63 WHERE age < 21 AND cluster_id IS NOT NULL AND theme IN (SELECT theme FROM scores) GROUP BY theme, cluster_id
  QUALIFY row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, cluster_id) = 1)"""

_LABELS = " ".join(f"WHEN '{d}' THEN '{d.replace('_', ' ').replace('lob', 'line of business')}'" for d in SEGMENT_DIMENSIONS)

EMERGING = f"""emerging AS (
  SELECT f.theme AS key, n.theme_name AS name, round(base_mean, 1) AS per_day_before, round(recent_mean, 1) AS per_day_now,
    round(lift, 2) AS lift, round(z, 1) AS z, onset, CAST(round((recent_mean - base_mean) * 21) AS BIGINT) AS extra_claims,
    CASE driver_dimension {_LABELS} END AS driver_dimension, driver_value, driver_before, driver_now, share_of_rise, share_text,
    top_cluster, top_cluster_share, {day_text('f.last_day - 20')} AS recent_from, {day_text('f.last_day')} AS recent_to,
    {day_text('f.last_day - 62')} AS base_from, {day_text('f.last_day - 21')} AS base_to
  FROM found f LEFT JOIN theme_dim n ON n.theme = f.theme LEFT JOIN driver_text d ON d.theme = f.theme
  LEFT JOIN onset o ON o.theme = f.theme LEFT JOIN top_cluster c ON c.theme = f.theme)"""

RISE = (WINDOW, DRIVER.replace("{scores}", "found"), ONSET.replace("{scores}", "found"), TOP_CLUSTER, EMERGING)


def _journey() -> str:
    rows = " UNION ALL ".join(
        f"""SELECT '{s}' AS stage, count(*) FILTER (WHERE pended AND pend_stage = '{s}') AS pended,
    coalesce(CAST(sum(pend_s) FILTER (WHERE pended AND pend_stage = '{s}') AS DOUBLE), 0) AS s,
    {mean_days(f'{s}_s', 2, 'NOT pended')} AS avg_days_clean,
    {mean_days(f'{s}_s', 2, f"pended AND pend_stage = '{s}'")} AS avg_days_when_pended_here,
    {mean_days(f'{s}_s', 2, 'pended')} AS avg_days_all_pended FROM claims"""
        for s in STAGE_ORDER)
    return f"""stage_rows AS ({rows}),
journey AS (
  SELECT r.stage, d.stage_name, r.pended, round(r.pended / nullif(t.all_claims, 0), 4) AS pended_share,
    round(r.s / 86400, 0) AS pend_days, round(r.s / t.all_s, 4) AS pend_days_share,
    avg_days_clean, avg_days_when_pended_here, avg_days_all_pended
  FROM stage_rows r JOIN stage_dim d ON d.stage = r.stage CROSS JOIN totals t)"""


SPINE = "spine AS (SELECT CAST(unnest(generate_series(min(received_date), max(received_date), INTERVAL 1 DAY)) AS DATE) AS d FROM claims)"
OVERVIEW = f"""overview AS (
  SELECT {day_text('s.d')} AS day, count(c.claim_id) AS received, count(*) FILTER (WHERE c.pended) AS pended,
    round(count(*) FILTER (WHERE c.pended) / nullif(count(c.claim_id), 0) * 100, 2) AS pended_rate
  FROM spine s LEFT JOIN claims c ON c.received_date = s.d GROUP BY s.d)"""


def _daily(keys: str, column: str) -> str:
    return f"""SELECT {day_text('s.d')} AS day, k.key, count(p.claim_id) AS pended
FROM spine s CROSS JOIN ({keys}) k LEFT JOIN pended p ON p.received_date = s.d AND p.{column} = k.key GROUP BY s.d, k.key"""


KPIS = f"""kpis AS (
  SELECT count(*) AS claims, count(*) FILTER (WHERE pended) AS pended,
  round(count(*) FILTER (WHERE pended) / count(*), 4) AS pended_rate,
  round(1 - count(*) FILTER (WHERE pended) / count(*), 4) AS first_pass_rate,
  {mean_days('tat_s', 1, 'NOT is_open AND NOT pended')} AS avg_days_clean,
  {mean_days('tat_s', 1, 'NOT is_open AND pended')} AS avg_days_pended,
  {mean_days('pend_s', 1, 'pended')} AS avg_pend_days,
  round(CAST(sum(pend_s) FILTER (WHERE pended) AS DOUBLE) / 86400, 0) AS pend_days_total,
  CAST(sum(touches) FILTER (WHERE pended) AS BIGINT) AS manual_touches, count(*) FILTER (WHERE over_target) AS over_target,
  round(count(*) FILTER (WHERE over_target AND pended) / nullif(count(*) FILTER (WHERE over_target), 0), 4) AS over_target_pended_share,
  count(*) FILTER (WHERE pended AND released_at IS NULL) AS open_pended,
  CAST(round(coalesce(sum(billed_amount) FILTER (WHERE pended AND released_at IS NULL), 0), 0) AS DOUBLE) AS open_pended_billed,
  30 AS target_days FROM claims)"""

LIST_SELECT = f"""SELECT claim_id, {day_text('received_date')} AS received_date, lob, platform, specialty, status, p.theme, t.theme_name,
  s.stage_name, pend_code, round(pend_s / 86400, 1) AS pend_days, round(age_s / 86400, 1) AS age_days,
  CAST(billed_amount AS DOUBLE) AS billed_amount, round(confidence, 2) AS confidence
FROM pended p LEFT JOIN theme_dim t ON t.theme = p.theme LEFT JOIN stage_dim s ON s.stage = p.pend_stage"""

RANK_COLUMNS = ("key, name, stage_name, claims, claims_share, avg_pend_days, pend_days, pend_days_share, over_target, open")

FINDINGS = """named AS (SELECT * FROM figures WHERE key <> 'needs_review'),
d AS (SELECT * FROM named ORDER BY pend_days DESC, key LIMIT 1),
c AS (SELECT * FROM named ORDER BY claims DESC, pend_days DESC, key LIMIT 1),
q AS (SELECT * FROM named ORDER BY avg_pend_days, pend_days DESC, key LIMIT 1),
findings AS (
  SELECT 1 AS seq, 'impact' AS kind, key AS theme, claims, claims_share, avg_pend_days AS avg_days, pend_days AS days, pend_days_share AS days_share, NULL::DOUBLE AS per_day_before, NULL::DOUBLE AS per_day_now, NULL::VARCHAR AS onset, NULL::VARCHAR AS driver_dimension, NULL::VARCHAR AS driver_value, NULL::DOUBLE AS driver_share, NULL::DOUBLE AS generic_share FROM d
  UNION ALL SELECT 2, 'frequent_but_quick', key AS theme, claims, claims_share, avg_pend_days AS avg_days, pend_days AS days, pend_days_share AS days_share, NULL::DOUBLE AS per_day_before, NULL::DOUBLE AS per_day_now, NULL::VARCHAR AS onset, NULL::VARCHAR AS driver_dimension, NULL::VARCHAR AS driver_value, NULL::DOUBLE AS driver_share, NULL::DOUBLE AS generic_share FROM q WHERE q.claims_share > q.pend_days_share * 2
  UNION ALL SELECT 2, 'frequent_not_costly', key AS theme, claims, claims_share, avg_pend_days AS avg_days, pend_days AS days, pend_days_share AS days_share, NULL::DOUBLE AS per_day_before, NULL::DOUBLE AS per_day_now, NULL::VARCHAR AS onset, NULL::VARCHAR AS driver_dimension, NULL::VARCHAR AS driver_value, NULL::DOUBLE AS driver_share, NULL::DOUBLE AS generic_share FROM c
    WHERE NOT (SELECT claims_share > pend_days_share * 2 FROM q) AND key <> (SELECT key FROM d)
  UNION ALL SELECT 3, 'emerging', key, NULL, NULL, NULL, NULL, NULL, per_day_before, per_day_now, onset, driver_dimension, driver_value,
    share_of_rise, NULL FROM (SELECT * FROM emerging ORDER BY lift DESC, key LIMIT 1) WHERE EXISTS (SELECT 1 FROM named)
  UNION ALL SELECT 4, 'visibility', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT max(generic_share) FROM figures)
    FROM d)"""

SQL = {
    "claim_measures": with_claims(
        "SELECT claim_id, is_open, over_target, round(pend_s / 86400, 4) AS pend_days, round(tat_s / 86400, 4) AS tat_days, "
        "round(age_s / 86400, 4) AS age_days, "
        + ", ".join(f"round({s}_s / 86400, 4) AS days_{s}" for s in STAGE_ORDER) + " FROM claims"),
    "theme_dim": with_claims(
        "SELECT d.theme, d.theme_ord, d.theme_name, d.stage, d.stage_name, d.theme_code, d.addressability, d.effort_level, d.theme_denial, "
        "count(p.claim_id) AS claims FROM theme_dim d LEFT JOIN pended p ON p.theme = d.theme GROUP BY ALL", PENDED),
    "scope_filter": with_claims(
        f"SELECT claim_id, {day_text('received_date')} AS received_date, lob, platform, pended FROM claims "
        "WHERE received_date >= DATE '1998-01-01' AND received_date <= DATE '1999-12-31' AND lob = 'BUILDING' AND platform = 'EUROPE'"),
    "kpis": with_claims("SELECT * FROM kpis", KPIS),
    "theme_table": with_claims(f"SELECT {THEME_COLUMNS} FROM figures", PENDED, TOTALS, FIGURES),
    **{
        f"rank_themes_{m}": with_claims(
            f"SELECT {RANK_COLUMNS}, CAST(row_number() OVER (ORDER BY {m} DESC, pend_days DESC, key) AS INTEGER) AS position FROM figures",
            PENDED, TOTALS, FIGURES)
        for m in ("pend_days", "claims", "avg_pend_days")
    },
    "segment_rates": with_claims(SEGMENT_SELECT + " WHERE theme = 'prior_auth'", PENDED, _long(("platform",)), RATES),
    "segments_all_dims": with_claims(SEGMENT_SELECT, PENDED, _long(), RATES),
    "segment_totals": with_claims(
        "SELECT value, claims_received, CAST(sum(pended) AS BIGINT) AS pended, round(sum(pended) / claims_received * 1000, 1) AS per_1000, "
        "first(theme ORDER BY per_1000 DESC, in_theme DESC, theme) AS worst_theme, max(per_1000) AS worst_per_1000 "
        "FROM rates r0 GROUP BY value, claims_received".replace("sum(pended)", "sum(r0.pended)").replace(
            "per_1000 DESC", "r0.per_1000 DESC").replace("max(per_1000)", "max(r0.per_1000)"),
        PENDED, _long(("platform",)), RATES),
    "most_affected": with_claims(
        "SELECT theme, dimension, CAST(position AS INTEGER) AS position, value, per_1000, index, "
        "row_number() OVER (PARTITION BY theme ORDER BY position, coalesce(index, 0) DESC, dim_ord) = 1 AS hottest FROM leaders",
        PENDED, _long(), RATES,
        "leaders AS (SELECT *, row_number() OVER (PARTITION BY theme, dim_ord ORDER BY per_1000 DESC, value) AS position FROM rates "
        "QUALIFY position <= 2)"),
    "hotspots": with_claims(
        "SELECT r.theme AS key, d.theme_name AS name, r.value, r.claims_received AS received, r.pended AS claims, r.per_1000, "
        "CAST(least(floor(coalesce(r.per_1000, 0) / greatest((SELECT max(per_1000) FROM rates), 1e-9) * 6.999), 6) AS INTEGER) AS heat "
        "FROM rates r LEFT JOIN theme_dim d ON d.theme = r.theme", PENDED, _long(("platform",)), RATES),
    "journey_stages": with_claims("SELECT * FROM journey", PENDED, TOTALS, _journey()),
    "journey_themes": with_claims(
        "SELECT stage, key, name, claims, claims_share, avg_pend_days, pend_days, pend_days_share FROM figures "
        "WHERE stage IS NOT NULL OR key = 'needs_review'", PENDED, TOTALS, FIGURES),
    "journey_totals": with_claims(
        "SELECT round(sum(coalesce(avg_days_clean, 0)), 2) AS clean_days, round(sum(coalesce(avg_days_all_pended, 0)), 2) AS pended_days "
        "FROM journey", PENDED, TOTALS, _journey()),
    "intake_by_channel": with_claims(
        f"SELECT channel, count(*) AS claims, {mean_days('intake_s', 2, 'NOT pended')} AS avg_intake_days_clean, "
        "round(count(*) FILTER (WHERE pended AND pend_stage = 'intake') / count(*) * 1000, 1) AS intake_pends_per_1000, "
        "count(*) FILTER (WHERE pended AND pend_stage = 'intake') AS intake_pended FROM claims GROUP BY channel"),
    "daily_overview": with_claims("SELECT * FROM overview", SPINE, OVERVIEW),
    "daily_by_stage": with_claims(_daily("SELECT stage AS key FROM stage_dim", "pend_stage"), PENDED, SPINE),
    "daily_by_theme": with_claims(_daily("SELECT DISTINCT theme AS key FROM pended WHERE theme IS NOT NULL", "theme"), PENDED, SPINE),
    "emerging": with_claims("SELECT * FROM emerging", PENDED, *RISE),
    "emerging_driver": with_claims("SELECT * FROM driver_text", PENDED, WINDOW, DRIVER.replace("{scores}", "scores")),
    "emerging_onset": with_claims("SELECT * FROM onset", PENDED, WINDOW, ONSET.replace("{scores}", "scores")),
    "emerging_status": with_claims(
        "SELECT CAST(max(received_date) - min(received_date) + 1 AS INTEGER) AS days_in_scope, "
        "max(received_date) - min(received_date) + 1 >= 63 AS checked, 63 AS needs_days FROM claims"),
    "emerging_top_cluster": with_claims("SELECT * FROM top_cluster", PENDED, WINDOW, TOP_CLUSTER),
    "rise_scores": with_claims(
        "SELECT theme, CAST(recent_sum AS BIGINT) AS recent_sum, CAST(base_sum AS BIGINT) AS base_sum, round(base_p95, 4) AS base_p95, "
        "round(lift, 4) AS lift, round(z, 4) AS z FROM scores", PENDED, WINDOW),
    "volume_basis": with_claims("SELECT * FROM basis", BASIS),
    "generic_code_share": with_claims(
        "SELECT count(*) AS pended, count(*) FILTER (WHERE pend_code = 'PND-000') AS generic, "
        "round(count(*) FILTER (WHERE pend_code = 'PND-000') / count(*), 4) AS generic_code_share FROM pended", PENDED),
    "meta": with_claims(
        "SELECT DISTINCT 'lob' AS kind, lob AS value FROM claims UNION ALL SELECT DISTINCT 'platform', platform FROM claims "
        "UNION ALL SELECT DISTINCT 'status', status FROM claims WHERE pended "
        f"UNION ALL SELECT 'date_min', {day_text('min(received_date)')} FROM claims "
        f"UNION ALL SELECT 'date_max', {day_text('max(received_date)')} FROM claims "
        f"UNION ALL SELECT 'as_of', {day_text('max(received_date) + 2')} FROM claims "
        "UNION ALL SELECT 'theme', theme FROM theme_dim UNION ALL SELECT 'stage', stage FROM stage_dim UNION ALL SELECT 'needs_days', '63' "
        "UNION ALL SELECT 'dimension', unnest(['platform', 'lob', 'specialty', 'channel', 'network_status', 'claim_type'])"),
    "interventions": with_claims(
        f"SELECT CAST(rank AS INTEGER) AS rank, {THEME_COLUMNS}, intervention, owner, why, addressability, effort, effort_level, "
        "recoverable_days, recoverable_claims, recoverable_touches, priority_score FROM ranked",
        PENDED, TOTALS, FIGURES, PLAN),
    "business_case": with_claims(
        "SELECT CAST(count(*) FILTER (WHERE rank <= 3) AS BIGINT) AS chosen, count(*) AS available, "
        + ", ".join(
            f"round(CAST(sum(recoverable_{u}) FILTER (WHERE rank <= 3) AS DOUBLE) * scale, 0) AS {u}_per_year" for u in ("touches", "days", "claims"))
        + ", round(CAST(sum(recoverable_touches) FILTER (WHERE rank <= 3) AS DOUBLE) * scale * 8, 0) AS cost_avoided FROM ranked, "
        "(SELECT CAST(0.7 AS DOUBLE) * (CAST(claims_per_year AS DOUBLE) / claims_in_window) AS scale FROM basis) GROUP BY scale",
        PENDED, TOTALS, FIGURES, PLAN, BASIS),
    "key_findings": with_claims("SELECT * FROM findings", PENDED, TOTALS, FIGURES, *RISE, FINDINGS),
    "top_providers": with_claims(
        "SELECT theme, provider_id, count(*) AS claims, arg_min(specialty, claim_id) AS specialty, "
        "CAST(row_number() OVER (PARTITION BY theme ORDER BY count(*) DESC, provider_id) AS INTEGER) AS position FROM pended "
        "WHERE theme IS NOT NULL GROUP BY theme, provider_id QUALIFY position <= 5", PENDED),
    "sample_notes": with_claims(
        "SELECT theme, CAST(row_number() OVER (PARTITION BY theme ORDER BY pend_s DESC, claim_id) AS INTEGER) AS position, claim_id, "
        "adjuster_note, pend_code, round_even(pend_s / 86400, 1) AS pend_days, confidence FROM pended WHERE theme IS NOT NULL "
        "QUALIFY position <= 6", PENDED),
    "claim_list_filtered": with_claims(
        LIST_SELECT + " WHERE p.theme = 'fwa_review' AND status = 'Paid' AND over_target ORDER BY pend_s DESC, claim_id LIMIT 50", PENDED),
    "claim_list": with_claims(LIST_SELECT + " ORDER BY pend_s DESC, claim_id LIMIT 25 OFFSET 25", PENDED),
    "claim_search": with_claims(
        LIST_SELECT + " WHERE contains(lower(claim_id), 'idiot') OR contains(lower(coalesce(adjuster_note, '')), 'idiot') "
        "OR contains(lower(provider_id), 'idiot')", PENDED),
    "claim_detail": with_claims(
        "SELECT claim_id, status, lob, platform, channel, claim_type, specialty, network_status, provider_id, "
        "CAST(billed_amount AS DOUBLE) AS billed_amount, round(age_s / 86400, 1) AS age_days, over_target, 30 AS target_days, pended, "
        "CASE WHEN pended THEN s.stage_name END AS stage_name, pend_code, adjuster_note AS note, round(pend_s / 86400, 1) AS pend_days, "
        "CAST(CASE WHEN pended THEN touches END AS INTEGER) AS touches, c.theme, t.theme_name, round(confidence, 2) AS confidence, "
        "CASE WHEN pended THEN released_at IS NULL END AS still_pended, c.denial_code, NULL::VARCHAR AS denial_text FROM claims c "
        "LEFT JOIN theme_dim t ON t.theme = c.theme LEFT JOIN stage_dim s ON s.stage = c.pend_stage"),
    "claim_timeline": with_claims(
        "SELECT claim_id, CAST(row_number() OVER (PARTITION BY claim_id ORDER BY at, ord) AS INTEGER) AS seq, event, "
        "strftime(make_timestamp(at * 1000000), '%Y-%m-%d %H:%M') AS at, (SELECT stage_name FROM stage_dim s WHERE s.stage = e0.stage) AS stage "
        "FROM events_long WHERE at IS NOT NULL".replace(
            "strftime(make_timestamp(at", "strftime(make_timestamp(e0.at").replace("FROM events_long WHERE at", "FROM events_long e0 WHERE e0.at").replace(
            "ORDER BY at, ord", "ORDER BY e0.at, ord"),
        """events_long AS (
  SELECT claim_id, 0 AS ord, 'received' AS event, received_at AS at, 'intake' AS stage FROM claims
  UNION ALL SELECT claim_id, 1, 'left_intake', intake_done_at, 'intake' FROM claims
  UNION ALL SELECT claim_id, 2, 'left_pre_adjudication', preadj_done_at, 'pre_adjudication' FROM claims
  UNION ALL SELECT claim_id, 3, 'left_adjudication', adjudicated_at, 'adjudication' FROM claims
  UNION ALL SELECT claim_id, 4, 'left_post_adjudication', finalized_at, 'post_adjudication' FROM claims
  UNION ALL SELECT claim_id, 5, 'hold_began', pended_at, pend_stage FROM claims WHERE pended
  UNION ALL SELECT claim_id, 6, 'hold_ended', released_at, pend_stage FROM claims WHERE pended)"""),
    "claim_stage_days": with_claims(" UNION ALL ".join(
        f"SELECT claim_id, '{s}' AS stage, round({s}_s / 86400, 2) AS days FROM claims" for s in STAGE_ORDER)),
    "cluster_profile": with_claims(
        f"SELECT p.theme, cluster_id, count(*) AS claims, round(count(*) / any_value(n), 4) AS share, {mean_days('pend_s', 1)} AS avg_pend_days, "
        "round(CAST(sum(pend_s) AS DOUBLE) / 86400, 0) AS pend_days FROM pended p "
        "JOIN (SELECT theme, count(*) AS n FROM pended GROUP BY theme) t ON t.theme = p.theme "
        "WHERE cluster_id IS NOT NULL GROUP BY p.theme, cluster_id", PENDED),
}
SQL["claim_page"] = SQL["claim_list"].replace("OFFSET 25", "OFFSET 3725")
SQL["claim_phrases"] = with_claims(
    "SELECT claim_id, pended, CASE WHEN NOT pended THEN NULL WHEN cluster_id IS NULL THEN '' ELSE upper(cluster_id) || '; of ' || theme END AS cluster_phrases FROM claims")
SQL["cluster_profile_named"] = "SELECT *, upper(cluster_id) || '; of ' || theme AS key_phrases, 'note of ' || cluster_id AS example_note FROM (" + SQL["cluster_profile"] + ")"
SQL["claim_lookup"] = SQL["claim_detail"] + " WHERE claim_id = 'C2600000007'"
SQL["interventions_top"] = SQL["interventions"] + " WHERE rank <= 4"
SQL["theme_playbook"] = with_claims(
    "SELECT DISTINCT p.theme, d.theme_name, d.stage_name, a.plain, a.why, a.intervention, a.owner FROM pended p LEFT JOIN theme_dim d ON d.theme = p.theme "
    "LEFT JOIN advice a ON a.theme = p.theme WHERE p.theme IS NOT NULL", PENDED, ADVICE)
