"""Every registered query with SQL equals it; every other one is held to account by name in the brute-force tests."""

import os

import pytest
from conftest import ROOT, rows

from quern.plans.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, sf, duck, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_named_by_a_brute_force_test(name):
    with open(os.path.join(ROOT, "tests", "test_brute_force.py")) as f:
        assert f'"{name}"' in f.read()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
