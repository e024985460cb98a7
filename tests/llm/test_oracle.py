"""The corpus queries with SQL agree with it on the smallest tables."""

import pytest

from pulseloom.llm import queries

from ..test_oracle import DATA, canonical, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, duck, name):  # noqa: F811
    columns, ours = canonical(queries.queries()[name](spark, DATA).toPandas())
    expected_columns, expected = canonical(duck.sql(queries.oracle_sql()[name]).df())
    assert (columns, ours) == (expected_columns, expected)
