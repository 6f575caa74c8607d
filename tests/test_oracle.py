"""Every registered query equals its oracle SQL (DuckDB) on the smallest
test scale: same columns, same rows, same values."""

import pytest

from fleetscope import registry
from tests.conftest import SF_SMALL
from tools.oracle_check import compare, duck

QUERIES = registry.queries()
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert res.startswith("ok"), res


def test_entry_runs(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert "queryid" in df.columns
