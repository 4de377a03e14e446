"""Small catalogues: stages, delay themes, effort levels and denial codes.

They are fixed in size (14 themes, 4 stages, 3 efforts, 9 codes), so joining them by broadcast is safe at any data
volume. They hold keys and numbers only; names follow from the keys. What a theme means, who owns it and what to do
about it is the user's knowledge: an ``advice`` table (theme, owner, plain, why, intervention), empty by default, and a
``texts`` table for denial codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.config import NEEDS_REVIEW, STAGE_ORDER
from pendscope.functions.columns import inline_table


def shown_name(key: str) -> str:
    """A readable name made from a key."""
    return key.replace("_", " ").capitalize()


STAGE_COLUMNS = {"stage": "string", "stage_ord": "int", "stage_name": "string"}
STAGES = tuple((stage, number, shown_name(stage)) for number, stage in enumerate(STAGE_ORDER))

EFFORT_COLUMNS = {"effort_level": "int", "effort": "string", "effort_weight": "double"}
# fixed values: effort weights
EFFORTS = ((1, "Low", 1.0), (2, "Medium", 2.0), (3, "High", 3.5))

THEME_COLUMNS = {
    "theme": "string", "theme_ord": "int", "theme_name": "string", "stage": "string", "theme_code": "string",
    "addressability": "double", "effort_level": "int", "theme_denial": "string",
}
# Key, stage, code, addressability, effort, denial code; their order is the order of the themes.
_THEMES = (
    ("edi_validation", "intake", "PND-110", 0.55, 1, "16"),
    ("intake_routing", "intake", "PND-120", 0.60, 1, None),
    ("member_match", "pre_adjudication", "PND-210", 0.50, 2, "31"),
    ("provider_match", "pre_adjudication", "PND-220", 0.70, 1, None),
    ("duplicate", "pre_adjudication", "PND-230", 0.65, 1, "18"),
    ("fwa_review", "pre_adjudication", "PND-240", 0.25, 3, "16"),
    ("eligibility", "adjudication", "PND-310", 0.55, 2, "27"),
    ("prior_auth", "adjudication", "PND-320", 0.60, 2, "197"),
    ("clinical_edit", "adjudication", "PND-330", 0.45, 2, "97"),
    ("medical_records", "adjudication", "PND-340", 0.40, 3, "50"),
    ("cob", "adjudication", "PND-350", 0.50, 2, "22"),
    ("pricing", "adjudication", "PND-360", 0.60, 2, None),
    ("payment_hold", "post_adjudication", "PND-410", 0.60, 1, None),
)
# Denial codes that a user may want texts for.
DENIALS = (("16",), ("18",), ("22",), ("27",), ("31",), ("50",), ("96",), ("97",), ("197",))
THEMES = tuple((key, number, shown_name(key), *rest) for number, (key, *rest) in enumerate(_THEMES))
REVIEW = (NEEDS_REVIEW, len(THEMES), shown_name(NEEDS_REVIEW), None, None, None, None, None)
ADVICE = ("owner", "plain", "why", "intervention")


def stage_dim(spark: SparkSession) -> DataFrame:
    return inline_table(spark, STAGES, STAGE_COLUMNS)


def effort_dim(spark: SparkSession) -> DataFrame:
    return inline_table(spark, EFFORTS, EFFORT_COLUMNS)


def denial_dim(spark: SparkSession, texts: DataFrame | None = None) -> DataFrame:
    """Denial codes with the text that ``texts`` (denial_code, denial_text) has for them, else null."""
    codes = inline_table(spark, DENIALS, {"denial_code": "string"})
    if texts is None:
        return codes.withColumn("denial_text", F.lit(None).cast("string"))
    return codes.join(texts.select("denial_code", "denial_text"), "denial_code", "left")


def with_advice(themes: DataFrame, advice: DataFrame | None = None) -> DataFrame:
    """``themes`` with the columns of ``advice``; null where it says nothing. It is read as one row per theme.
    Its size is the user's affair, so Spark chooses the join by the size it finds."""
    if advice is None:
        return themes.withColumns({name: F.lit(None).cast("string") for name in ADVICE})
    return themes.join(advice.select("theme", *ADVICE).dropDuplicates(["theme"]), "theme", "left")


def playbook(spark: SparkSession) -> DataFrame:
    """The 13 themes that can be acted on; ``needs_review`` is not one of them."""
    return inline_table(spark, THEMES, THEME_COLUMNS)


def theme_dim(spark: SparkSession) -> DataFrame:
    """All themes a claim can carry, with the stage name; ``needs_review`` has no stage."""
    review = inline_table(spark, (REVIEW,), THEME_COLUMNS)
    return playbook(spark).unionByName(review).join(stage_dim(spark), "stage", "left")
