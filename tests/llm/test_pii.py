"""Pseudonyms: permutations, round trips, formats, links between documents."""

from __future__ import annotations

import re

import pytest

from llm_cases import awkward, nothing, wide  # noqa: F401
from pendscope.llm import pii

KEY = b"a key of the tests"
VALUES = [
    ("email", "jo.Doe+x@mail7.example.com"), ("card", "4111111111111111"), ("card", "4111-1111-1111-1111"), ("card", "3782 822463 10005"), ("ip", "97.51.17.173"),
    ("date", "2020-02-29"), ("date", "31.12.1999"), ("date", "12/13/1999"), ("date", "02/03/2004"), ("ssn", "123-45-6789"), ("ssn", "667-01-0001"),
    ("phone", "+1 (017) 555-7713"), ("phone", "030 555-0199"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("iban", "DE89370400440532013000"),
]


@pytest.mark.parametrize("size", [2, 3, 10, 97, 1000, 4096])
def test_permutation(size):
    image = [pii.permuted(k, size, "kind", b"key") for k in range(size)]
    assert sorted(image) == list(range(size)) and all(a != b for a, b in enumerate(image))
    assert [pii.permuted(v, size, "kind", b"key", back=True) for v in image] == list(range(size))


@pytest.mark.parametrize("kind,value", VALUES)
def test_round_trip_and_format(kind, value):
    text = f"see {value} there"
    changed, spots = pii.replaced(text, KEY)
    assert [k for _, _, k in spots] == [kind] and value not in changed
    again = changed[4:-6]
    assert pii.pseudonym(kind, again, KEY, back=True) == value
    assert [k for _, _, k in pii.found_in(changed, KEY)] == [kind]  # the pseudonym is valid too
    if kind != "ip":
        assert re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", again)))[:-3] == re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", value)))[:-3]


@pytest.mark.parametrize("text", ["4111111111111112", "300.1.2.3", "2021-02-30", "000-12-3456", "GB00WEST12345698765432", "@", "a@b", "1.2.3", "v1.2.3.4.5", "12345",
                                  "0000000000000000", "x" * 100_000 + "@", "@" * 10_000, "1" * 50_000, "", "née 2020"])
def test_invalid_values_stay(text):
    assert pii.replaced(text, KEY) == (None, [])


def test_linked_and_injective(spark, awkward, wide, nothing):
    mails = [f"u{k}@mail{k % 7}.example.com" for k in range(300)]
    docs = spark.createDataFrame([(k, f"a {m}, b", m) for k, m in enumerate(mails)] + [(1000 + k, f"c {m}\nd", m) for k, m in enumerate(mails)],
                                 "doc_id bigint, text string, mail string")
    rows = pii.pseudonymise(docs, KEY).collect()
    seen = {}
    for row in rows:
        seen.setdefault(row["mail"], set()).add(re.search(r"\S+@[\w.]+\w", row["text"])[0])
    assert all(len(v) == 1 for v in seen.values()) and len({*map(min, seen.values())}) == 300
    assert not {m for v in seen.values() for m in v} & set(mails)
    other = pii.pseudonymise(docs, key=b"another").first()["text"]
    assert other != pii.pseudonymise(docs, KEY).first()["text"]

    assert [(r["doc_id"], r["text"]) for r in pii.pii_pseudonyms(awkward, KEY).collect()] == [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert pii.pseudonymised_documents(wide, KEY).columns == wide.columns
    assert pii.pii_pseudonyms(nothing, KEY).count() == 0
