"""Queries of the package beside their SQL at the smallest scale."""

import pytest

from pairwell.llm import queries
from suite.compare import bag, database
from tests.llm.conftest import SF_DIR


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    df = queries.queries()[name](spark, SF_DIR)
    result = database(SF_DIR).execute(queries.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    assert bag(df.columns, df.collect()) == bag(names, result.fetchall())
