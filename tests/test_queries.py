import pytest
from compare import difference

from tabularium.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, data, name):
    assert difference(spark, registry.QUERIES[name], registry.SQL[name], data) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() >= 0
