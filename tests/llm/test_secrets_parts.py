"""Random values in runs that fit no alphabet as a whole."""

from __future__ import annotations

import random

from pendscope.llm import secrets as s


def test_values_behind_names_and_in_paths(spark):
    rng = random.Random(11)
    plain = s.UPPER + s.LOWER + s.DIGITS

    def key(letters):
        return "a1Z" + "".join(rng.choice(letters) for _ in range(37))

    forms = [("AWS_ACCESS_KEY_ID2=", plain + "+/", ""), ("DB_KEY=", plain, ""), ("DB_KEY=", plain, "=="), ("/hooks/a_b/", plain, ""),
             ("/hooks/a-b/", plain + "-_", "/x_y"), ("", plain, "")]
    rows = []
    for n, (before, letters, after) in enumerate(forms):
        for k in range(100):
            value = key(letters)
            padding = after if after.startswith("=") else ""
            rows.append((n * 1000 + k, f"see {before}{value}{after} here", f"random:{4 + len(before)}:{4 + len(before) + len(value) + len(padding)}"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, want string")
    found = s.secret_scan(docs).join(docs.select("doc_id", "want"), "doc_id").collect()
    for n, form in enumerate(forms):
        hits = sum(r["spans"] == r["want"] for r in found if r["doc_id"] // 1000 == n)
        assert hits > 75, (form, hits, [r for r in found if r["doc_id"] // 1000 == n and r["spans"] != r["want"]][:3])


def test_padding_and_short_parts(spark):
    rows = [(0, "abcdefghij12345678=="), (0, "AB1=" + "c2D" * 8 + "="), (0, "2021-ab12-cd34/ef56_gh78/x"), (0, "=" * 40 + "a1")]
    tokens = spark.createDataFrame([(w,) for _, w in rows], "word string").selectExpr("0L AS start", "bigint(length(word)) AS stop", "word")
    found = s.parted(s.parted(s.parted(tokens, "A-Za-z0-9+/_-", True), "A-Za-z0-9+_-"), "A-Za-z0-9+").collect()
    assert sorted((r["start"], r["stop"], r["word"]) for r in found) == [(0, 20, "abcdefghij12345678=="), (4, 29, "c2D" * 8 + "=")]
