"""Every registered query next to its SQL twin on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, open_oracle

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
#: Findings that the smallest tables do not hold.
MAY_BE_EMPTY = {"op6_secret_scan"}


@pytest.fixture(scope="module")
def oracle(sf_dir):
    return open_oracle(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, oracle, name):
    df = QUERIES[name](spark, sf_dir)
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLES:
        assert compare(df, oracle, ORACLES[name]) == ""
    else:
        assert df.count() > 0 or name in MAY_BE_EMPTY


def test_every_twin_belongs_to_a_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
