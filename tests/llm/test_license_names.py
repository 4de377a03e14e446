"""A template is not found without the word that tells its license from the others."""

from __future__ import annotations

from pendscope.llm import license_scan as ls

CASES = [
    ("Licensed under the Apache License, version 2.0", "apache-2", 1.0),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3", 1.0),
    ("This work is licensed under the GNU General Public License, version 2.", "", 11 / 12),
    ("This work is licensed under the European Union Public License, version 3.", "", 10 / 12),
    ("Licensed under CC BY 4.0", "", 6 / 7),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc", 1.0),
    ("Released under the MIT license", "mit", 1.0),
    ("licensed " + "word " * 8 + "under the mit " + "word " * 8 + "license", "", 3 / 5),
    ("Permission is hereby granted, free of charge, to any person getting a copy of this software", "mit", 14 / 15),
    ("nothing of the kind", "", 0.0),
]


def test_distinguishing_words(spark):
    docs = spark.createDataFrame([(k, text) for k, (text, _, _) in enumerate(CASES)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in ls.license_scan(docs).collect()}
    assert got == {k: (labels, round(score, 9)) for k, (_, labels, score) in enumerate(CASES)}
