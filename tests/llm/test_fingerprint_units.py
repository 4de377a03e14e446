"""Units do not hang on an offset; a short text shares marks with a long one that quotes it."""

from __future__ import annotations

import random

from llm_cases import STORY
from pendscope.llm import fingerprints as fp


def hashes(shown):
    return {mark.split("@")[0] for mark in shown.split()}


def test_shifted_and_quoted(spark):
    rng = random.Random(3)
    unspaced = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000))
    filler = " ".join(f"filler{k}" for k in range(300))
    texts = [unspaced, "x" + unspaced, STORY, f"{filler} {STORY} {filler}", "short words here", "y" * 17]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in fp.document_fingerprints(docs).collect()}
    assert rows[0]["near_next"] > 0.9
    assert hashes(rows[2]["fingerprint"]) & hashes(rows[3]["fingerprint"])
    assert rows[4]["fingerprint"] and rows[5]["fingerprint"]
