"""SQL twins of the queries over notes, documents, embeddings, conversations and events."""

from __future__ import annotations

from oracle.base import day_text, with_claims
from oracle.claims_sql import FIGURES, KPIS, OVERVIEW, PENDED, SPINE, TOTALS, _daily, _journey
from pendscope.operators import routing
from pendscope.plans.text_queries import COMMON_WORDS, K_RULES, REBUILT_DAYS, SPLIT_SAMPLE, STATED_BIAS, STATED_LABELS, stated_term

WORDS = r"""words AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS words FROM documents),
pairs AS (SELECT *, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM words)"""
COUNTS = WORDS + """,
counts AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_concat(words, pairs)) AS term FROM pairs) GROUP BY ALL),
vocabulary AS (SELECT term, count(*) AS df FROM counts GROUP BY term HAVING count(*) >= 3)"""

CODE_THEME = "SELECT p.*, b.theme AS code_theme FROM pended p LEFT JOIN playbook b ON b.theme_code = p.pend_code"

SCORES = """classes AS (
  SELECT class, sum(support) AS support, sum(given) AS given, sum(hit) AS hit FROM (
    SELECT true_theme AS class, count(*) AS support, 0 AS given, count(*) FILTER (WHERE theme = true_theme) AS hit FROM pended GROUP BY ALL
    UNION ALL SELECT theme, 0, count(*), 0 FROM pended GROUP BY ALL) WHERE class IS NOT NULL GROUP BY class)"""


def _pairs(label: str) -> str:
    return f"points AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, {label} FROM embeddings)"


def _mean_silhouette(label: str) -> str:
    """Every point against every other one."""
    return f"""(SELECT avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) FROM (
  SELECT i, max(m) FILTER (WHERE same) AS a, min(m) FILTER (WHERE NOT same) AS b FROM (
    SELECT x.vec_id AS i, x.{label} = y.{label} AS same, y.{label} AS other, avg(pow(list_distance(x.e, y.e), 2)) AS m
    FROM points x JOIN points y ON x.vec_id <> y.vec_id GROUP BY x.vec_id, x.{label} = y.{label}, y.{label})
  GROUP BY i))"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def _first(catalogue) -> str:
    return "CASE " + " ".join(f"WHEN {_any(words)} THEN '{key}'" for key, words in catalogue.items()) + " END"


PLATFORM = "contains(q, 'system')"
PLATFORMS = " OR EXISTS (SELECT 1 FROM region WHERE contains(q, lower(r_name)))"

# half of the questions carry a claim id made from their own number
ROUTE = rf"""WITH conversations AS (
  SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 THEN text || ' (c26' || lpad(CAST(conv_id AS VARCHAR), 8, '0') || ')'
    WHEN conv_id % 4 = 1 THEN text || ' in asia' ELSE text END AS text FROM main.conversations),
asked AS (
  SELECT conv_id, turn, text, ' ' || trim(lower(text), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || ' ' AS q,
    nullif(regexp_extract(upper(text), '\bC26\d{{8}}\b'), '') AS claim FROM conversations WHERE role = 'user'),
found AS (SELECT *, {_first(routing.THEME_WORDS)} AS t, {_first(routing.DIMENSION_WORDS).replace(PLATFORM, PLATFORM + PLATFORMS)} AS d FROM asked),
routed AS (SELECT *, CASE WHEN claim IS NOT NULL THEN 'claim' WHEN {_any(routing.INTERVENE_WORDS)} THEN 'intervene'
  WHEN {_any(routing.EMERGING_WORDS)} THEN 'emerging' WHEN t IS NOT NULL AND d IS NULL THEN 'theme' WHEN d IS NOT NULL THEN 'dimension'
  WHEN {_any(routing.STAGE_WORDS)} THEN 'stage' WHEN {_any(routing.RANKING_WORDS)} THEN 'ranking' ELSE 'summary' END AS intent FROM found)
SELECT conv_id, turn, length(text) BETWEEN 1 AND 1000 AS accepted, intent,
  CASE intent {' '.join(f"WHEN '{i}' THEN '{t}'" for i, t in routing.TOOLS.items())} END AS tool,
  CASE WHEN intent = 'claim' THEN claim END AS claim_id, CASE WHEN intent IN ('theme', 'dimension') THEN t END AS theme,
  CASE WHEN intent = 'dimension' THEN d END AS dimension,
  CASE WHEN intent <> 'ranking' THEN NULL WHEN {_any(routing.VOLUME_WORDS)} THEN 'claims'
    WHEN {_any(routing.LENGTH_WORDS)} THEN 'avg_pend_days' ELSE 'pend_days' END AS metric,
  CASE WHEN intent = 'intervene' THEN 3 END AS top_n,
  '{{' || array_to_string(list_filter([
    CASE WHEN intent = 'claim' THEN '"claim_id":"' || claim || '"' END,
    CASE WHEN intent IN ('theme', 'dimension') AND t IS NOT NULL THEN '"theme":"' || t || '"' END,
    CASE WHEN intent = 'dimension' THEN '"dimension":"' || d || '"' END,
    CASE WHEN intent <> 'ranking' THEN NULL WHEN {_any(routing.VOLUME_WORDS)} THEN '"metric":"claims"'
      WHEN {_any(routing.LENGTH_WORDS)} THEN '"metric":"avg_pend_days"' ELSE '"metric":"pend_days"' END,
    CASE WHEN intent = 'intervene' THEN '"top_n":3' END], lambda x: x IS NOT NULL), ',') || '}}' AS evidence_args FROM routed"""

_CHECKS = " UNION ALL ".join((
    "SELECT 'daily received' AS name, (SELECT sum(received) FROM overview) AS l, claims AS r, 0 AS allowed FROM kpis",
    "SELECT 'daily pended', (SELECT sum(pended) FROM overview), pended, 0 FROM kpis",
    "SELECT 'theme claims', (SELECT sum(claims) FROM figures), pended, 0 FROM kpis",
    "SELECT 'theme days', (SELECT sum(pend_days) FROM figures), pend_days_total, (SELECT count(*) FROM figures) FROM kpis",
    "SELECT 'stage pended', (SELECT sum(pended) FROM journey), pended, 0 FROM kpis",
    "SELECT 'theme series', (SELECT sum(pended) FROM series), (SELECT sum(claims) FROM figures), 0",
))

def _literal(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else f"{value!r}::DOUBLE"


_TERMS = [stated_term(i) for i in range(len(COMMON_WORDS))]
_SCORES = range(len(STATED_LABELS))
SCORED = f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
model(term, idf, {", ".join(f"c{j}" for j in _SCORES)}) AS (VALUES {", ".join("(" + ", ".join(map(_literal, (t, idf, *coefs))) + ")" for t, idf, coefs in _TERMS)}),
weights AS (SELECT doc_id, {", ".join(f"c{j}" for j in _SCORES)}, (1 + ln(count(*))) * idf AS w FROM words JOIN model USING (term) GROUP BY doc_id, term, idf, {", ".join(f"c{j}" for j in _SCORES)}),
sums AS (SELECT doc_id, sqrt(sum(w * w)) AS norm, {", ".join(f"sum(w * c{j}) AS s{j}" for j in _SCORES)} FROM weights GROUP BY doc_id),
margins AS (SELECT doc_id, [{", ".join(f"{STATED_BIAS[j]!r}::DOUBLE + coalesce(s{j} / norm, 0)" for j in _SCORES)}] AS m FROM documents LEFT JOIN sums USING (doc_id)),
best AS (SELECT doc_id, [{", ".join(map(_literal, STATED_LABELS))}][list_position(m, list_max(m))] AS label,
  1 / list_sum(list_transform(m, lambda x: exp(x - list_max(m)))) AS confidence FROM margins)
SELECT doc_id, CASE WHEN confidence >= 0.55 THEN label ELSE 'needs_review' END AS label, round(confidence, 6) AS confidence FROM best"""

WEIGHED = """notes AS MATERIALIZED (SELECT lang AS theme, coalesce(text, '') AS note, sha1(coalesce(text, '')) AS note_id, count(*) AS claims FROM documents
  WHERE lang IS NOT NULL AND lang <> 'needs_review' GROUP BY ALL),
words AS (SELECT *, regexp_extract_all(lower(note), '[\\p{L}\\p{N}_]{2,}') AS words FROM notes),
pairs AS (SELECT *, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS pairs FROM words),
counts AS (SELECT theme, note_id, claims, term, count(*) AS tf FROM (
  SELECT theme, note_id, claims, unnest(list_concat(words, pairs)) AS term FROM pairs) GROUP BY ALL),
common AS (SELECT theme, term, sum(claims) AS df FROM counts GROUP BY ALL HAVING sum(claims) >= 3),
sizes AS (SELECT theme, sum(claims) AS n_docs FROM notes GROUP BY theme),
raw AS (SELECT theme, note_id, claims, term, (1 + ln(tf)) * (ln((1 + n_docs) / (1 + df)) + 1) AS raw
  FROM counts JOIN common USING (theme, term) JOIN sizes USING (theme)),
weights AS MATERIALIZED (SELECT theme, note_id, claims, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY theme, note_id)) AS weight FROM raw),
square AS MATERIALIZED (SELECT theme, note_id, sum(weight * weight) AS square FROM weights GROUP BY ALL)"""


def _race(slot: int, d2: str) -> str:
    draw = f"CAST('0x' || substr(md5(note_id || ':1:{slot}'), 1, 13) AS BIGINT)"
    return f"arg_min(note_id, {{'a': {d2} <= 0, 'b': -ln(({draw} + 1) / 4503599627370496) / claims / CASE WHEN {d2} > 0 THEN {d2} ELSE 1 END, 'c': note_id}})"


def _gaps(name: str, centres: str) -> str:
    """(theme, note_id, claims, c, gap) of every note to every centre of (theme, c, term, v)."""
    return f"""norms{name} AS (SELECT theme, c, sum(v * v) AS norm FROM {centres} GROUP BY ALL),
dots{name} AS (SELECT w.theme, w.note_id, c, sum(w.weight * v) AS dot FROM weights w JOIN {centres} USING (theme, term) GROUP BY ALL),
gaps{name} AS MATERIALIZED (SELECT n.theme, n.note_id, n.claims, m.c, greatest(0, round(coalesce(square, 0) + norm - 2 * coalesce(dot, 0), 9)) AS gap
  FROM notes n JOIN norms{name} m USING (theme) LEFT JOIN dots{name} d ON d.theme = n.theme AND d.note_id = n.note_id AND d.c = m.c
  LEFT JOIN square s ON s.theme = n.theme AND s.note_id = n.note_id)"""


def _means(name: str, gaps: str) -> str:
    return f"""labels{name} AS MATERIALIZED (SELECT theme, note_id, claims, CASE WHEN max(gap) FILTER (WHERE c = 0) <= max(gap) FILTER (WHERE c = 1) THEN 0 ELSE 1 END AS c
  FROM {gaps} GROUP BY ALL),
filled{name} AS (SELECT theme, c, sum(claims) AS size FROM labels{name} GROUP BY ALL),
means{name} AS MATERIALIZED (SELECT l.theme, l.c, w.term, sum(w.claims * weight) / any_value(size) AS v FROM weights w JOIN labels{name} l USING (theme, note_id)
  JOIN filled{name} f ON f.theme = l.theme AND f.c = l.c GROUP BY ALL)"""


# both clusters keep notes in every round here, as a note is never nearer to another centre than to itself
STEP = f"""WITH {WEIGHED},
first AS (SELECT theme, 0 AS c, {_race(0, '1')} AS note_id FROM notes GROUP BY theme),
start AS (SELECT p.theme, p.c, w.term, w.weight AS v FROM first p JOIN weights w USING (theme, note_id)),
{_gaps('0', 'start')},
second AS (SELECT theme, 1 AS c, {_race(1, 'gap')} AS note_id FROM gaps0 GROUP BY theme),
seeds AS MATERIALIZED (SELECT * FROM start UNION ALL SELECT p.theme, p.c, w.term, w.weight FROM second p JOIN weights w USING (theme, note_id)),
{_gaps('1', 'seeds')}, {_means('1', 'gaps1')}, {_gaps('2', 'means1')}, {_means('2', 'gaps2')},
lengths AS (SELECT theme, c, sum(v * v) AS length FROM means2 GROUP BY ALL)
SELECT theme, c AS cluster, CAST(size AS BIGINT) AS size, round(length, 6) AS length FROM filled2 JOIN lengths USING (theme, c)"""

PHRASES = f"""WITH RECURSIVE {WEIGHED},
members AS (SELECT theme, note_id, claims, theme || ':' || ascii(note_id) % 3 AS cluster_id FROM notes),
per_term AS (SELECT w.theme, cluster_id, term, sum(weight * w.claims) AS total FROM weights w JOIN members USING (theme, note_id) GROUP BY ALL),
overall AS (SELECT theme, term, sum(total) AS theme_total FROM per_term GROUP BY ALL),
in_cluster AS (SELECT theme, cluster_id, sum(claims) AS cluster_claims FROM members GROUP BY ALL),
scored AS MATERIALIZED (SELECT c.cluster_id, o.term, string_split(o.term, ' ') AS words, round(coalesce(total, 0) / cluster_claims - theme_total / n_docs, 9) AS lead
  FROM overall o JOIN in_cluster c USING (theme) JOIN sizes USING (theme) LEFT JOIN per_term p ON p.cluster_id = c.cluster_id AND p.term = o.term AND p.theme = o.theme),
chosen AS (
  SELECT cluster_id, CAST([] AS VARCHAR[]) AS phrases FROM in_cluster
  UNION ALL
  SELECT c.cluster_id, list_append(any_value(c.phrases), arg_max(s.term, {{'l': s.lead, 't': s.term}})) FROM chosen c JOIN scored s ON s.cluster_id = c.cluster_id
  WHERE len(c.phrases) < 4 AND len(list_filter(c.phrases, lambda p: list_has_all(s.words, string_split(p, ' ')) OR list_has_all(string_split(p, ' '), s.words))) = 0
  GROUP BY c.cluster_id)
SELECT cluster_id, array_to_string(arg_max(phrases, len(phrases)), '; ') AS key_phrases FROM chosen GROUP BY cluster_id"""

MEMBERS = """WITH stated AS (SELECT lang AS theme, doc_id % 7 % 4 AS label, 1 + doc_id % 3 AS claims, text AS note, doc_id * 37 % 101 / 8 AS distance FROM documents),
ranks AS (SELECT theme, label, CAST(sum(claims) AS BIGINT) AS claims, theme || ':' || row_number() OVER (PARTITION BY theme ORDER BY sum(claims) DESC, label) AS cluster_id
  FROM stated GROUP BY theme, label)"""

_STOP = ", ".join(f"'{w}'" for w in COMMON_WORDS)

SQL = {
    "tokens": f"WITH {WORDS}, kept AS (SELECT *, list_filter(words, lambda x: x NOT IN ({_STOP})) AS kept FROM pairs) "
              "SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words, CAST(len(pairs) AS INTEGER) AS n_pairs, "
              "md5(array_to_string(words, ' ')) AS words_md5, md5(array_to_string(pairs, '|')) AS pairs_md5, "
              "CAST(len(kept) AS INTEGER) AS n_kept, md5(array_to_string(kept, ' ')) AS kept_md5 FROM kept",
    "vocabulary": f"WITH {COUNTS} SELECT term, df FROM vocabulary",
    "tfidf_weights": f"""WITH {COUNTS},
raw AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS raw FROM counts JOIN vocabulary USING (term))
SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
    "label_split": f"""WITH drawn AS (SELECT doc_id, lang, md5(doc_id || ':1') AS draw FROM documents ORDER BY draw, doc_id LIMIT {SPLIT_SAMPLE}),
split AS (SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY draw, doc_id) <= 0.25 * count(*) OVER (PARTITION BY lang)
  THEN 'test' ELSE 'train' END AS split FROM drawn)
SELECT d.doc_id, d.lang, coalesce(s.split, 'unlabelled') AS split FROM documents d LEFT JOIN split s ON s.doc_id = d.doc_id""",
    "doc_text": with_claims(
        "SELECT claim_id, coalesce(adjuster_note, '') || ' pendcode_' || lower(replace(coalesce(pend_code, 'none'), '-', '_')) AS text "
        "FROM claims WHERE pended"),
    "confidence_floor": with_claims(
        "SELECT claim_id, CASE WHEN confidence >= 0.55 THEN true_theme ELSE 'needs_review' END AS theme, confidence FROM claims WHERE pended"),
    "enrich_join": with_claims(
        "SELECT c.claim_id, c.status, c.pended, p.theme, p.confidence, p.cluster_id FROM claims c LEFT JOIN pended p ON p.claim_id = c.claim_id", PENDED),
    "classifier_metrics": with_claims(
        "SELECT b.theme, b.theme_name AS name, round(coalesce(hit / nullif(given, 0), 0), 3) AS precision, "
        "round(coalesce(hit / nullif(support, 0), 0), 3) AS recall, CAST(coalesce(support, 0) AS BIGINT) AS support "
        "FROM playbook b LEFT JOIN classes c ON c.class = b.theme", PENDED, SCORES),
    "confusion_matrix": with_claims(
        "SELECT a.theme AS label, b.theme AS predicted, coalesce(n, 0) AS n FROM playbook a CROSS JOIN playbook b "
        "LEFT JOIN (SELECT true_theme, theme, count(*) AS n FROM pended GROUP BY ALL) c ON c.true_theme = a.theme AND c.theme = b.theme", PENDED),
    "holdout_summary": with_claims(
        "SELECT round(sum(hit) / sum(support), 4) AS accuracy, round(avg(2 * hit / (support + given)), 4) AS macro_f1 FROM classes", PENDED, SCORES),
    "review_shares": with_claims(
        "SELECT count(*) AS pended_claims, round(count(*) FILTER (WHERE theme <> 'needs_review') / count(*), 4) AS auto_classified_share, "
        "round(count(*) FILTER (WHERE theme = 'needs_review') / count(*), 4) AS needs_review_share, "
        "round(count(*) FILTER (WHERE theme = true_theme) / count(*) FILTER (WHERE theme <> 'needs_review'), 4) AS accuracy_on_assigned FROM pended",
        PENDED),
    "code_only_accuracy": with_claims(
        "SELECT count(*) AS pended, round(count(*) FILTER (WHERE pend_code = 'PND-000') / count(*), 4) AS generic_code_share, "
        f"round(count(*) FILTER (WHERE code_theme = true_theme) / count(*), 4) AS code_only_correct_share FROM ({CODE_THEME})", PENDED),
    "adjusted_rand": with_claims(
        "SELECT c.theme, k.clusters, w.known, round((s0 - s1 * s2 / (n * (n - 1) / 2)) / ((s1 + s2) / 2 - s1 * s2 / (n * (n - 1) / 2)), 3) "
        "AS adjusted_rand_index FROM cells c JOIN known w USING (theme) JOIN found k USING (theme)",
        PENDED + ", labelled AS (SELECT * FROM pended WHERE cluster_id IS NOT NULL)",
        "cells AS (SELECT theme, sum(n * (n - 1) / 2) AS s0, sum(n) AS n FROM (SELECT theme, true_sub_cause, cluster_id, count(*) AS n "
        "FROM labelled GROUP BY ALL) GROUP BY theme)",
        "known AS (SELECT theme, sum(n * (n - 1) / 2) AS s1, count(*) AS known FROM (SELECT theme, true_sub_cause, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY theme)",
        "found AS (SELECT theme, sum(n * (n - 1) / 2) AS s2, count(*) AS clusters FROM (SELECT theme, cluster_id, count(*) AS n FROM labelled GROUP BY ALL) GROUP BY theme)"),
    "silhouette": f"WITH {_pairs('label')} SELECT 'label' AS labelling, (SELECT count(*) FROM points) AS points, "
                  f"round({_mean_silhouette('label')}, 5) AS silhouette",
    "silhouette_sampled": """WITH points AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings ORDER BY md5(vec_id || ':1'), vec_id LIMIT 1500),
means AS (SELECT x.vec_id AS i, x.label = y.label AS same, y.label AS other, avg(list_distance(x.e, y.e)) AS m
  FROM points x JOIN points y ON x.vec_id <> y.vec_id GROUP BY x.vec_id, x.label = y.label, y.label),
each AS (SELECT i, max(m) FILTER (WHERE same) AS a, min(m) FILTER (WHERE NOT same) AS b FROM means GROUP BY i)
SELECT (SELECT count(*) FROM points) AS points, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM each""",
    "choose_k": f"WITH {_pairs(', '.join(f'{rule} AS {name}' for name, rule in K_RULES.items()))}, scores AS ("
                + " UNION ALL ".join(f"SELECT {name[1:]} AS k, {_mean_silhouette(name)} AS s" for name in K_RULES)
                + ") SELECT CAST(min(k) AS INTEGER) AS k, round(arg_min(s, k), 5) AS silhouette FROM scores WHERE s >= (SELECT max(s) FROM scores) - 0.03",
    "route_questions": ROUTE,
    "score_documents": SCORED,
    "fit_check": """WITH sample AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents WHERE lang IS NOT NULL ORDER BY md5(doc_id || ':1'), doc_id LIMIT 1200),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS words FROM sample),
terms AS (SELECT DISTINCT doc_id, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS term FROM words)
SELECT (SELECT count(*) FROM sample) AS documents, (SELECT CAST(count(DISTINCT lang) AS INTEGER) FROM sample) AS labels,
  (SELECT count(*) FROM (SELECT term FROM terms GROUP BY term HAVING count(*) >= 2)) AS terms, true AS proven""",
    "rebuild_window": with_claims(
        "SELECT claim_id, status, pended, pend_code, CAST(billed_amount AS DOUBLE) AS billed_amount, pended AS has_theme, "
        f"(SELECT {day_text('last_day + 2')} FROM edge) AS as_of FROM claims WHERE received_date > last_day - {REBUILT_DAYS}"),
    "rebuild_span_plain": with_claims(
        "SELECT claim_id, status, pended, pend_code, CAST(billed_amount AS DOUBLE) AS billed_amount, pended AS has_theme, "
        f"(SELECT {day_text('last_day + 2')} FROM edge) AS as_of FROM claims"),
    "rebuild_changed_day": with_claims(
        "SELECT claim_id, CASE WHEN changed AND CAST(substr(claim_id, 4) AS BIGINT) % 2 = 0 THEN 'Denied' ELSE status END AS status, pended, pend_code, "
        "CAST(billed_amount AS DOUBLE) + CASE WHEN changed THEN 1 ELSE 0 END AS billed_amount, pended AS has_theme, "
        f"(SELECT {day_text('last_day + 2')} FROM edge) AS as_of FROM (SELECT *, received_date = last_day - 10 AS changed FROM claims "
        f"WHERE received_date > last_day - {REBUILT_DAYS})"),
    "cluster_step": STEP,
    "key_phrases": PHRASES,
    "cluster_relabel": MEMBERS + " SELECT theme, CAST(label AS INTEGER) AS label, cluster_id, claims FROM ranks",
    "cluster_examples": MEMBERS + """ SELECT cluster_id, r.theme, r.claims, (SELECT md5(arg_min(s.note, struct_pack(d := s.distance, n := s.note)))
  FROM stated s WHERE s.theme = r.theme AND s.label = r.label) AS example_md5 FROM ranks r""",
    "events_daily": f"SELECT {day_text('ts')} AS day, event_type AS key, count(*) AS n FROM events GROUP BY ALL",
    "reconcile": with_claims(
        "SELECT name, CAST(l AS DOUBLE) AS left_side, CAST(r AS DOUBLE) AS right_side, abs(CAST(l AS DOUBLE) - CAST(r AS DOUBLE)) <= allowed AS passed "
        f"FROM ({_CHECKS})", PENDED, TOTALS, FIGURES, KPIS, SPINE, OVERVIEW, _journey(),
        "series AS (" + _daily("SELECT DISTINCT theme AS key FROM pended WHERE theme IS NOT NULL", "theme") + ")"),
}

