"""Small tables with every awkward row, for the operators of the llm folder."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = " ".join(f"w{k % 700}x{k}" for k in range(20_000))
STORY = ("The quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen liquor jugs near "
         "the old stone bridge, and nobody in the sleepy village seems to notice the strange procession at all. ") * 3
AWKWARD = [
    (1, STORY, "en", "a"),
    (2, STORY, "en", "a"),
    (3, STORY.replace("wizards", "witches", 1), "en", "b"),
    (4, None, None, None),
    (5, "", "en", "a"),
    (6, " \n\t ", "en", ""),
    (7, LONG, "xx", "c"),
    (8, "!!! ### $$$", "en", "a"),
    (9, "Ünïcödé 日本語テキスト 😀😀 \u2028 naïve", "de", "b"),
    (10, "one two three", "en", "b"),
    (None, STORY + " tail", "en", "b"),
    (12, "one two three", None, None),
    (12, "one two three", None, None),
    (13, "x" * 5000, "en", "d"),
]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame([(*row, None if row[1] is None else len(row[1])) for row in AWKWARD], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that the operators use inside.
CLASHING = ("size", "hash", "key", "row", "at", "body", "words", "chars", "bucket", "copy", "place", "node", "least", "score", "spans", "pii",
            "ids", "_hash", "count", "host", "path", "c", "s", "d", "kept")


@pytest.fixture(scope="session")
def wide(awkward):
    from pyspark.sql import functions as F

    return awkward.select("*", *(F.lit("extra").alias(name) for name in CLASHING))
