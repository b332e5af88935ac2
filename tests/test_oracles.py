"""Each registered query against its SQL, and the contract of the registry."""

import pytest

from tests.compare import same
from veridelta import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name in SQL:
        same(got, duck.sql(SQL[name]).df())
    else:
        assert len(got) > 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
    assert registry.FLAGSHIP in SQL


def test_a_name_registers_once():
    with pytest.raises(ValueError, match="twice"):
        registry.query(registry.FLAGSHIP)(lambda: None)
