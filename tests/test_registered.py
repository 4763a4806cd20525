"""Every registered query against its SQL over whole tables."""

import pytest

import __spark_entry__ as registered
from tests.check_oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


#: The queries of the library itself; those of the removable part have tests of their own.
OWN = {name for module in registered._MODULES for name in module.R.queries}


@pytest.mark.parametrize("name", sorted(OWN))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, sf_dir) == ""


def test_entry(spark):
    assert registered.entry(spark).columns == ["query_id", "vec_id", "distance"]


def test_every_query_has_sql():
    assert OWN <= set(registered.oracle_sql())
