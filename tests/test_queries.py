"""Every registered query against its SQL on the smallest tables; those without SQL must give rows."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from conftest import SMALL
from oracle import connect, difference

MAY_BE_EMPTY = {"mcar_flags", "corr_flagged", "best_run", "comissing_pairs", "duplicate_keys"}


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, SMALL)
    sql = contract.oracle_sql().get(name)
    if sql:
        assert difference(df, con, sql) is None
    elif name not in MAY_BE_EMPTY:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    rows = contract.entry(spark).collect()
    assert {r["scenario"] for r in rows} == {"base", "adverse", "severe"}
