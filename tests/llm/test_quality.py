"""Counts against a plain calculation; verdicts of hosts."""

from __future__ import annotations

import re

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import quality_rules as q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    threes = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    twice = {t for t in threes if threes.count(t) > 1} if len(threes) < 3000 else {t for t in set(threes) if threes.count(t) > 1}
    covered = {k + j for k, t in enumerate(threes) if t in twice for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_counts(awkward):
    texts = [row["text"] for row in awkward.collect() if len(row["text"] or "") < 20_000]
    texts += ["a b c a b c a", "a a a a", "a b\n\na b\n \nc", "a\x1cb c", "x|y <z>", "a b a b a"]
    for text in texts:
        assert q.counts(text) == plain(text), text


def test_verdicts(spark):
    clean = " ".join(f"plain{k}word" for k in range(80))
    noisy = " ".join(f"plain{k}w" + "#" * (k % 4 == 0) for k in range(80))
    rows = [(k, clean, "good") for k in range(30)] + [(100, noisy, "good")] + [(200 + k, noisy, "bad") for k in range(30)] + [(300, clean, "bad"), (301, "short", "good")]
    rows += [(302, " ".join(f"plain{k}w###" for k in range(80)), "good"), (303, "One line of the page at the top.\n" + clean + "\nOne line of the page at the top.", "good")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    kept = {row["doc_id"] for row in q.quality(docs).collect() if row["kept"]}
    assert kept == {*range(30), 100, 300, 303}  # one slip in a good host is forgiven, a clean text of a bad host stays
    assert {row["doc_id"] for row in q.kept_documents(docs).collect()} == kept


def test_awkward_rows(awkward, wide, nothing):
    rows = q.quality(awkward).collect()
    assert len(rows) == awkward.count()
    assert all(row["base_failed"] and not row["kept"] for row in rows if row["n_words"] < 50)
    assert q.kept_documents(wide).columns == wide.columns
    assert q.quality(nothing).count() == 0 and q.kept_documents(nothing).count() == 0
    assert sorted(row["doc_id"] for row in q.kept_documents(awkward).collect()) == sorted(row["doc_id"] for row in rows if row["kept"])
