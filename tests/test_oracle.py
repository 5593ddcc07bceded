"""Every registered query against its SQL counterpart."""

import harness
import pytest

import __spark_entry__ as entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(folder):
    return harness.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, folder, con):
    df = QUERIES[name](spark, folder)
    if name not in ORACLES:
        assert df.count() > 0
        return
    assert harness.compare(df, con, ORACLES[name]) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
