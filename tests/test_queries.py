"""Every registered query runs; those with SQL give its rows."""

import os

import pytest
from oracle import DATA, oracle_rows, spark_rows

from loomgraph.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    columns, rows = spark_rows(QUERIES[name](spark, DATA))
    assert columns
    if name in ORACLES:
        assert (columns, rows) == oracle_rows(ORACLES[name])


def test_every_oracle_has_its_query():
    assert ORACLES.keys() <= QUERIES.keys()


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert __spark_entry__.queries().keys() >= QUERIES.keys()
