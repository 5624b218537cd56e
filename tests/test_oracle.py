"""Every registered query against its SQL on the smallest tables."""

import pytest

from suite.compare import difference, tables
from suite.oracle import ORACLE
from suite.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return tables(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert difference(found, db, ORACLE[name]) is None
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
