"""Every query of the library against its SQL; the tables may be any size."""

import pytest

from rollcall import queries, queries_records  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, same, sf, name):
    same(queries.QUERIES[name](spark, sf), queries.SQL[name])


def test_every_query_has_sql():
    assert set(queries.SQL) == set(queries.QUERIES)
