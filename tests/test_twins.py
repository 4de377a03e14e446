"""Every query with an SQL twin against DuckDB, on the smallest tables."""

from __future__ import annotations

import os
import sys

import pytest

from conftest import ROOT, SF_DIR

sys.path.insert(0, os.path.join(ROOT, "tools"))

from compare import compare, connect  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, con, name):
    good, text = compare(spark, con, name, SF_DIR)
    assert good, text


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
