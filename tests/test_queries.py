"""Every registered query against its SQL on the smallest data."""

import oracle
import pytest

from shopledger.queries.catalog import all_queries

QUERIES = all_queries()
WITH_SQL = [n for n, q in QUERIES.items() if q.sql]


@pytest.fixture(scope="module")
def con(sf):
    return oracle.duck(sf)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_agrees_with_sql(spark, sf, con, name):
    q = QUERIES[name]
    problems = [p for p in oracle.compare(spark, con, sf, q.build, q.sql) if p != "no rows"]
    assert problems == []


def test_catalog_is_complete():
    assert len(QUERIES) > 250
    assert all(n == n.lower() and " " not in n for n in QUERIES)
