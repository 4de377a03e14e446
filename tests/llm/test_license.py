"""Base places and containment against a scan of every window."""

from __future__ import annotations

import random
import re

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import license_scan as ls

TEXTS = [
    "Released under the MIT License.", "x UNDER THE mit-license, under the MIT license under the mit license", "Apache License, Version 2.0",
    "Licensed under CC BY-NC 4.0.", "mit der Lizenz under the sea", "This work is licensed under the GNU General Public License, version 3.",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software", None, "", "under the éMIT license",
    "word " * 500 + "apache license version 2" + " word" * 700, "licensed under the apache something else license version two 2 0",
]


def plain(text):
    words = re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    starts = [(k, label) for phrase, label in ls.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    stride = max(len(t.split()) for _, t in ls.TEMPLATES)
    best = {}
    for block in range(-1, len(words) // stride + 1):
        held = set(words[max(0, block * stride):(block + 2) * stride])
        for label, t in ls.TEMPLATES:
            share = len(held & set(t.split())) / len(set(t.split()))
            if share >= ls.CONTAINED - 1e-9:
                best[label] = max(best.get(label, 0), share)
    return len(words), sorted(starts), sorted({label for _, label in starts} | set(best)), max(best.values(), default=0.0)


def test_against_every_window(spark, awkward):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text"))
    got = sorted(((r["n_words"], sorted((s["at"], s["label"]) for s in r["starts"]), r["labels"], round(r["score"], 9)) for r in ls.license_matches(docs).collect()), key=str)
    want = sorted(((*plain(r["text"])[:3], round(plain(r["text"])[3], 9)) for r in docs.collect()), key=str)
    assert got == want


def held_apart(templates):
    """Necessary words and refuting groups, from the definition."""
    for label, text in templates:
        words, must, refuted = set(text.split()), set(), []
        for other_label, other in templates:
            more = set(other.split())
            if other_label != label and len(words - more) <= ls.NEAR * len(words):
                must |= words - more
                refuted += [more - words] if not words - more else []
        yield label, words, words if len(text.split()) < ls.WHOLE_BELOW else must, refuted, len(text.split()) + -(-len(text.split()) // 4)


def registered(text, templates=ls.TEMPLATES):
    """Labels and score of the registered query: every window of every template."""
    words = re.findall(ls.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = {label for phrase, label in ls.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()}
    labels, best = set(base), 1.0 if base else 0.0
    stride = max(width for *_, width in held_apart(templates))
    for label, mine, must, refuted, width in held_apart(templates):
        if not any(len(mine & set(words[max(0, b * stride):(b + 2) * stride])) >= ls.CONTAINED * len(mine) - 1e-9 for b in range(-1, len(words) // stride + 1)):
            continue
        for k in range(len(words)):
            held = set(words[k:k + width])
            best = max(best, len(held & mine) / len(mine))
            if len(held & mine) >= ls.CONTAINED * len(mine) - 1e-9 and must <= held and not any(group <= held for group in refuted):
                labels.add(label)
    return sorted(labels), round(best, 9)


def variants():
    """Templates whole, with a word lost, with one changed, torn apart, and next to each other."""
    dice = random.Random(5)
    for _, t in ls.TEMPLATES:
        words = t.split()
        yield t.title()
        yield from (" ".join(words[:k] + words[k + 1:]) for k in range(len(words)))
        yield "so " + " ".join(w if dice.random() > 0.15 else "other" for w in words) + " end"
        yield " ".join(words[:len(words) // 2]) + " far" * 40 + " " + " ".join(words[len(words) // 2:])
    for _ in range(40):
        yield " x y ".join(dice.choice(ls.TEMPLATES)[1] for _ in range(3))


def test_registered_path_against_every_window(spark, awkward):
    docs = spark.createDataFrame(list(enumerate([*TEXTS, *variants()])), "doc_id bigint, text string").unionByName(awkward.select("doc_id", "text"))
    got = sorted((r["labels"].split(",") if r["labels"] else [], round(r["score"], 9)) for r in ls.license_scan(docs).collect())
    texts = [registered(r["text"]) for r in docs.collect()]
    assert got == sorted(texts)
    assert any(0 < score < 1 and labels for labels, score in texts)  # contained in part, and proved


def test_near_licenses_are_told_apart():
    told = dict(zip((text for _, text in ls.TEMPLATES), ls.telling_words()))
    for label, kind, version in (("gpl-2", "general", "2"), ("gpl-3", "general", "3"), ("lgpl-3", "lesser general", "3"), ("agpl-3", "affero general", "3")):
        text = ls._NOTICE.format(kind + " public license", version)
        assert registered(text) == ([label], 1.0) and version in told[text][0]
    assert ["lesser"] in told[ls._NOTICE.format("general public license", "3")][1]
    assert registered("licensed under the gnu lesser general public license version 3")[0] == ["lgpl-3"]
    assert registered("licensed under the free license version 3")[0] == []


def test_templates_of_the_user(spark):
    own = (("red", " ".join(f"w{k}" for k in range(20)) + " red"), ("blue", " ".join(f"w{k}" for k in range(20)) + " blue"))
    texts = [own[0][1], own[1][1], " ".join(f"w{k}" for k in range(20)), own[1][1].replace("w3 ", "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["labels"], round(r["score"], 9)) for r in ls.license_matches(docs, templates=own, own_windows=True).collect()}
    assert got == {k: registered(t, own) for k, t in enumerate(texts)} and got[0][0] == ["red"] and got[2][0] == [] and got[3][0] == ["blue"]


def test_shape(wide, nothing):
    assert ls.license_scan(wide).count() == wide.count()
    assert ls.license_scan(nothing).count() == 0
