"""Every operator query that has SQL gives its rows."""

import pytest

from tests import oracle
from tracewell.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    assert oracle.difference(registry.queries()[name](spark, SF).toPandas(), oracle.sql_rows(SF, registry.oracle_sql()[name])) == ""
