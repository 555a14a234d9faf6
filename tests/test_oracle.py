"""Every registered query of the library beside its SQL on the smallest tables."""

import pytest

from millrace.plans import registry
from tests.compare import compare, connection

SF = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, con, name):
    assert compare(con, registry.queries()[name](spark, SF), SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0
