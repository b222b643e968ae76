"""Every registered document query against its DuckDB twin, over whole tables."""

import pytest
from conftest import DATA, same_rows

from foliomill import oracle
from foliomill.queries import QUERIES

SQL = oracle.sql()


def test_each_query_has_a_twin():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck, SQL[name])
