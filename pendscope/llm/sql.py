"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_MIX = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS hash FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
    2 * source_size AS most, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget FROM sizes),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY most::DOUBLE / weight, source NULLS LAST) AS place, budget - coalesce(CAST(sum(most) OVER w AS BIGINT), 0) AS rest,
    CAST(sum(weight) OVER () AS BIGINT) - coalesce(CAST(sum(weight) OVER w AS BIGINT), 0) AS weight_left
  FROM weighted WINDOW w AS (ORDER BY most::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, most * weight_left <= weight * rest AS stopped FROM ordered),
targets AS (
  SELECT source, source_size, CASE WHEN stopped THEN most::DOUBLE ELSE weight * (
    SELECT arg_min(rest / weight_left, place) FROM levels WHERE NOT stopped) END AS target FROM levels),
budgets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, CAST(floor(target) AS BIGINT) // source_size) END AS whole FROM targets),
placed AS (
  SELECT r.doc_id, r.size, b.source_size, b.target, b.whole,
    CASE WHEN b.whole = 2 THEN 0 ELSE CAST(floor(b.target) AS BIGINT) - b.whole * b.source_size END AS room,
    coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.hash, r.doc_id, r.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM rows r JOIN budgets b ON r.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, room - before)) AS BIGINT) AS taken FROM placed
"""

#: The rules, stated a second time: a twin that took them from the operator would agree with a wrong one.
RULES = {
    "symbols": "n_symbols * 10 > n_words",
    "mostly_symbols": "n_symbols > n_words",
    "dup_lines": "n_dup_lines >= 2 AND n_dup_lines * 10 > n_lines * 3",
    "repeats": "n_repeat_words * 10 > n_words * 3",
    "word_length": "NOT (word_chars >= 3 * n_words AND word_chars <= 12 * n_words)",
}
BASE = "(n_words < 50 OR n_repeat_words * 2 > n_words)"
_SHRUNK = " OR ".join(
    f"(({rule}) AND (f.{r} + m.{r}_s * m.{r}_m) / (f.n + m.{r}_s) > 0.3)" for r, rule in RULES.items())

_QUALITY = rf"""
WITH split AS (
  SELECT doc_id, source, {_WORDS} AS words, coalesce(text, '') AS body,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
tri AS (
  SELECT doc_id, words, list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) AS three FROM split),
placed AS (SELECT doc_id, unnest(three) AS t, generate_subscripts(three, 1) AS i FROM tri),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM placed) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + s) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS s) GROUP BY doc_id),
counted AS (
  SELECT s.doc_id, s.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(body, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(body, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id),
hosts AS (SELECT source, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {rule}) AS {r}" for r, rule in RULES.items())} FROM counted GROUP BY source),
means AS (SELECT {", ".join(f"avg({r} / n) AS {r}_m, var_pop({r} / n) AS {r}_v" for r in RULES)} FROM hosts),
m AS (SELECT *, {", ".join(f"CASE WHEN {r}_v > 1e-12 THEN greatest(1, least(1000, {r}_m * (1 - {r}_m) / {r}_v - 1)) ELSE 1000 END AS {r}_s" for r in RULES)} FROM means)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed,
  NOT ({BASE}) AND NOT ({_SHRUNK}) AND {" + ".join(f"CAST(({rule}) AS INT)" for rule in RULES.values())} < 2 AS kept
FROM counted c JOIN hosts f ON c.source IS NOT DISTINCT FROM f.source, m
"""

_CHAT_CONTROLS = ("<|im_start|>", "<|im_end|>", "<|nl|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters that escaping adds: one for every escape character and for every control string, none of which overlap themselves.
_ADDED = " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in ("\\", *_CHAT_CONTROLS))

_CHAT_FORMAT = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
told AS (
  SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS before FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (
  SELECT *, coalesce(CASE role WHEN 'system' THEN place = 0 WHEN 'user' THEN place = 0 OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN before = 'user' END, false) AS legal FROM told)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + {_ADDED}) AS BIGINT) AS formatted_chars,
  bool_and(legal) AND arg_max(role, place) = 'assistant' AS valid, min(place) FILTER (WHERE NOT legal) AS first_fault
FROM judged GROUP BY conv_id
"""

_HARD_NEGATIVES = """
WITH rows AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

_SPACES = r"\x20\x09-\x0D"
#: CRC-32 of a text of digits and colons, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: list_reduce(
    [0, 0, 0, 0, 0, 0, 0, 0], lambda d, k: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END, xor(c, b)), CAST(4294967295 AS BIGINT)))"""


def _add(state: str, cost: str, letter: str, line: str) -> str:
    """A survivor with one more edit; a line that is kept goes behind those before it."""
    kept = f"{state}.r || CASE WHEN {state}.r = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {letter}, 'r': {kept}}}"


def _inserted(e: str, s: str, u: str, a: str) -> str:
    open_turn = "least({u}, {0}, {1}, {2})".format(*(_add(x, "5", "'I'", "'user:'") for x in (e, s, a)), u=u)
    return f"{{'e': {e}, 's': {s}, 'u': {open_turn}, 'a': {a}}}"


# One survivor per state as (cost, audit, repaired); structs compare field by field, so least() is the rule of the contract.
_NONE = "{'c': 1000000000, 'a': '', 'r': ''}"
_SHOWN = "role || ':' || text"
_CHAT_REPAIR = rf"""
WITH RECURSIVE damaged AS (
  SELECT *, {_CRC} % 20 AS fate FROM (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations)),
rows AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM damaged, (SELECT unnest([0, 1]) AS copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (
  SELECT *, row_number() OVER w AS place, lag(role[1]) OVER w || role[1] AS step FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^{_SPACES}]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][{_SPACES}]*\z') THEN 'truncated' ELSE '' END AS fault FROM placed),
search AS (
  SELECT conv_id, 0 AS place, {{'c': 0, 'a': '', 'r': ''}} AS e, {_NONE} AS s, {_NONE} AS u, {_NONE} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, place, {_add("e", "2", "'D'", "")},
    CASE WHEN forced THEN {_add("s", "2", "'D'", "")} ELSE least({_add("s", "2", "'D'", "")},
      CASE WHEN initial = 's' THEN {_add("e", "stays", "'K'", _SHOWN)} ELSE {_NONE} END) END,
    CASE WHEN forced THEN {_add("u", "2", "'D'", "")} ELSE least({_add("u", "2", "'D'", "")}, {", ".join(
      _add(x, "stays + CASE WHEN initial = 'u' THEN 0 ELSE 1 END", "CASE WHEN initial = 'u' THEN 'K' ELSE 'R' END",
           "CASE WHEN initial = 'u' THEN role ELSE 'user' END || ':' || text") for x in ("e", "s", "a"))}) END,
    CASE WHEN forced THEN {_add("a", "2", "'D'", "")} ELSE least({_add("a", "2", "'D'", "")}, {
      _add("u", "stays + CASE WHEN initial = 'a' THEN 0 ELSE 1 END", "CASE WHEN initial = 'a' THEN 'K' ELSE 'R' END",
           "CASE WHEN initial = 'a' THEN role ELSE 'assistant' END || ':' || text")}) END
  FROM (
    SELECT conv_id, place, role, text, initial, forced, stays, m.e AS e, m.s AS s, m.u AS u, least(m.a, {_add("m.u", "5", "'I'", "'assistant:'")}) AS a FROM (
      SELECT p.conv_id, f.place, f.role, f.text, f.role[1] AS initial, f.fault IN ('blank', 'duplicate') AS forced,
        CASE WHEN f.fault = 'truncated' THEN 5 ELSE 0 END AS stays, {_inserted("p.e", "p.s", "p.u", "p.a")} AS m
      FROM search p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.place = p.place + 1))),
done AS (
  SELECT conv_id, least(m.e, m.a, {_add("m.u", "5", "'I'", "'assistant:'")}) AS best FROM (
    SELECT conv_id, {_inserted("e", "s", "u", "a")} AS m FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1)),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE step NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(best.r) AS repaired_sha256
FROM done d LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
"""

SQL = {
    "op2_source_mix": _MIX, "op3_quality_rules": _QUALITY, "op11_chat_repair": _CHAT_REPAIR, "op12_chat_format": _CHAT_FORMAT,
    "op13_hard_negatives": _HARD_NEGATIVES,
}
