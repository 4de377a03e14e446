"""Which analysis a typed question asks for, for a whole table of questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.config import NEEDS_REVIEW

# ---- fixed values: word lists, patterns and limits; their order decides ------
CLAIM_ID_PATTERN = r"\bC26\d{8}\b"
MAX_QUESTION = 1000
THEME_WORDS = {
    "edi_validation": ("format", "edi", "syntax", "hipaa", "paper", "scan", "data error"),
    "intake_routing": ("misrout", "routing", "wrong queue", "split"),
    "member_match": ("member match", "member could", "member pick", "newborn", "subscriber id"),
    "provider_match": ("provider match", "provider or tax", "tax id", "tin", "npi", "provider pick", "roster"),
    "duplicate": ("duplicate", "dup ", "resubmi"),
    "fwa_review": ("fraud", "fwa", "waste", "abuse", "siu"),
    "eligibility": ("eligib", "coverage", "termed", "retro"),
    "prior_auth": ("prior auth", "authoriz", "authoris", "precert", " pa ", "auth"),
    "clinical_edit": ("clinical edit", "bundl", "coding", "modifier"),
    "medical_records": ("medical record", "records", "medical necessity", "clinical review"),
    "cob": ("cob", "coordination", "other insurance", "primary insurer", "secondary"),
    "pricing": ("pricing", "price", "contract", "fee schedule", "out of network", "out-of-network", "non-par"),
    "payment_hold": ("payment", "eft", "check run", "bank"),
    NEEDS_REVIEW: ("needs review", "human review", "unclassified", "low confidence"),
}
DIMENSION_WORDS = {
    "platform": ("platform", "system"),
    "lob": ("line of business", "lob", "commercial", "medicare", "medicaid"),
    "specialty": ("specialty", "specialties", "radiology", "orthop", "cardio"),
    "channel": ("channel", "clearinghouse", "portal", "mail"),
    "network_status": ("network", "par "),
    "claim_type": ("institutional", "professional", "claim type"),
}
INTERVENE_WORDS = ("interven", "first", "priorit", "fix", "recommend", "what should", "action", "invest")
EMERGING_WORDS = ("worse", "emerging", "rising", "spike", "increas", "recent", "trend", "changed", "new ")
STAGE_WORDS = ("stage", "intake", "adjudication", "stuck", "where in", "journey")
RANKING_WORDS = ("most", "top", "biggest", "rank", "driver", "theme", "cause", "why", "cost")
VOLUME_WORDS = ("volume", "count", "how many", "frequent")
LENGTH_WORDS = ("longest", "slowest")
TOOLS = {
    "claim": "lookup_claim",
    "intervene": "recommend_interventions",
    "emerging": "find_emerging_themes",
    "theme": "explain_theme",
    "dimension": "compare_segments",
    "stage": "stage_breakdown",
    "ranking": "rank_delay_themes",
    "summary": "summary",
}
# ---- end of fixed values -----------------------------------------------------


def _any(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(q, '" + word.replace("\\", "\\\\").replace("'", "\\'") + "')" for word in words) + ")"


def with_platforms(platforms: Sequence[str]) -> dict[str, tuple[str, ...]]:
    """The dimension words together with the names of the user's platforms."""
    return DIMENSION_WORDS | {"platform": (*DIMENSION_WORDS["platform"], *(name.lower() for name in platforms))}


def _first_key(catalogue: dict[str, tuple[str, ...]]) -> str:
    return "CASE " + " ".join(f"WHEN {_any(words)} THEN '{key}'" for key, words in catalogue.items()) + " END"


def route_questions(questions: DataFrame, text: str = "text", platforms: Sequence[str] = ()) -> DataFrame:
    """Adds the tool a question leads to and its arguments. ``platforms`` are the platform names a question may hold.

    ``accepted`` is false for an empty or overlong question; it is still routed, so
    that no row is lost. The rules are one chain of conditions, evaluated in the JVM."""
    blanks = r"' \t\n\r\u000b\u000c'"
    words = questions.withColumns({
        "q": F.expr(f"concat(' ', btrim(lower({text}), {blanks}), ' ')"),
        "claim_id": F.expr(f"nullif(regexp_extract(upper({text}), r'{CLAIM_ID_PATTERN}', 0), '')"),
        "accepted": F.expr(f"length({text}) BETWEEN 1 AND {MAX_QUESTION}"),
    })
    found = words.withColumns({"theme": F.expr(_first_key(THEME_WORDS)), "dimension": F.expr(_first_key(with_platforms(platforms)))})
    intent = (
        "CASE WHEN claim_id IS NOT NULL THEN 'claim' "
        f"WHEN {_any(INTERVENE_WORDS)} THEN 'intervene' "
        f"WHEN {_any(EMERGING_WORDS)} THEN 'emerging' "
        "WHEN theme IS NOT NULL AND dimension IS NULL THEN 'theme' "
        "WHEN dimension IS NOT NULL THEN 'dimension' "
        f"WHEN {_any(STAGE_WORDS)} THEN 'stage' "
        f"WHEN {_any(RANKING_WORDS)} THEN 'ranking' ELSE 'summary' END"
    )
    metric = (f"CASE WHEN intent <> 'ranking' THEN NULL WHEN {_any(VOLUME_WORDS)} THEN 'claims' "
              f"WHEN {_any(LENGTH_WORDS)} THEN 'avg_pend_days' ELSE 'pend_days' END")
    routed = found.withColumn("intent", F.expr(intent)).withColumn("metric", F.expr(metric))
    tools = "CASE intent " + " ".join(f"WHEN '{i}' THEN '{tool}'" for i, tool in TOOLS.items()) + " END"
    args = {
        "claim_id": "if(intent = 'claim', claim_id, NULL)",
        "theme": "if(intent IN ('theme', 'dimension'), theme, NULL)",
        "dimension": "if(intent = 'dimension', dimension, NULL)",
        "metric": "metric",
        "top_n": "if(intent = 'intervene', 3, NULL)",
    }
    return routed.selectExpr(
        *questions.columns, "accepted", "intent", f"{tools} AS tool", *(f"{value} AS {name}" for name, value in args.items()),
        f"to_json(struct({', '.join(f'{value} AS {name}' for name, value in args.items())})) AS evidence_args")
