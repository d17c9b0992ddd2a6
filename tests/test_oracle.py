"""Every registered query against its SQL twin on the small tables."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


def test_every_twin_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        assert oracle.differences(got, duck.execute(SQL[name]).df()) == []
    else:
        assert len(got) > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
