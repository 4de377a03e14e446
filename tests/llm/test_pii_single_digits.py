"""A network address of single digits is found whatever else the text holds."""

from __future__ import annotations

import re

import pytest

from pendscope.llm import pii

KEY = b"a key of the tests"


@pytest.mark.parametrize("address", ["8.8.4.4", "1.1.1.1"])
def test_address_alone(address):
    changed, spots = pii.replaced(f"server {address} down", KEY)
    assert spots == [(7, 14, "ip")] and address not in changed
    linked, _ = pii.replaced(f"room 12, {address}", KEY)
    assert re.search(r"[0-9]+(?:\.[0-9]+){3}", linked)[0] == re.search(r"[0-9]+(?:\.[0-9]+){3}", changed)[0]


def test_version_stays():
    assert pii.replaced("release 1.2", KEY) == (None, [])
