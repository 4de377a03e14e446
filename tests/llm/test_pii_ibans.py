"""Account numbers are found whatever word follows them."""

from __future__ import annotations

import pytest

from pendscope.llm import pii

KEY = b"a key of the tests"

IBANS = ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES9121000418450200051332", "GB82 WEST 1234 5698 7654 32"]


@pytest.mark.parametrize("iban", IBANS)
@pytest.mark.parametrize("after", ["EUR", "BIC", "1200", "BIC 1200 EUR", "TRANSFER", "", "eur", "EUR 12"])
def test_word_behind(iban, after):
    text = f"pay {iban} {after}"
    changed, spots = pii.replaced(text, KEY)
    assert spots == [(4, 4 + len(iban), "iban")]
    assert changed[4:4 + len(iban)] == pii.pseudonym("iban", iban, KEY) and changed[4 + len(iban):] == f" {after}"


def test_one_behind_another():
    text = "ES91 2100 0418 4502 0005 1332 BE68 5390 0754 7034 and AB12 CDEF 1234 GB82 WEST 1234 5698 7654 32"
    assert [text[a:b] for a, b, _ in pii.found_in(text, KEY)] == ["ES91 2100 0418 4502 0005 1332", "BE68 5390 0754 7034", "GB82 WEST 1234 5698 7654 32"]
