import pytest
from shared import DATA, same_as_duckdb

from marlstone.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same_as_duckdb(spark, duck, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0
