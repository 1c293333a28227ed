"""Every core query runs, and equals its SQL where it has one."""

import pytest

import __spark_entry__
from tests_data import DATA
from weftline.plans import oracle, queries


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_same_as_sql(same_as_sql, name):
    same_as_sql(queries.QUERIES[name], oracle.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracle.SQL)))
def test_runs(spark, duck, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1
