"""Every query of the catalog against its SQL on the smallest tables; queries without SQL run and have rows."""

import pytest
from oracle import assert_same

from quillframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, name):
    assert_same(spark, SF, name, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_rows(spark, name):
    assert catalog.queries()[name](spark, SF).limit(5).count() > 0


def test_plans(spark):
    banded = catalog.queries()["candidates_in_band"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in banded and "Cartesian" not in banded
    page = catalog.queries()["scan_page"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in page
