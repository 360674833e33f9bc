"""Every registered query of the engine gives the rows of its SQL."""

import pytest

from tests import oracle
from tracewell.plans import dataset, more, movement, reading, registry, stages, tracing, traps

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def one_case(spark):
    """The stages of the analysis are computed once for all queries."""
    shared = registry.case_of(spark, SF)
    with pytest.MonkeyPatch.context() as patch:
        for module in (registry, dataset, more, movement, reading, stages, tracing, traps):
            patch.setattr(module, "case_of", lambda *_: shared)
        yield


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    assert oracle.difference(got, oracle.sql_rows(SF, registry.oracle_sql()[name])) == ""


def test_every_query_runs(spark):
    for name in sorted(set(registry.queries()) - set(registry.oracle_sql())):
        assert registry.queries()[name](spark, SF).toPandas() is not None
