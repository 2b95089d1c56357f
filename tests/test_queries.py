"""Every catalogue query: equal to its SQL twin, or at least runnable with rows."""

import pytest
from oracle import differences

from flowquarry.plans import CATALOGUE

WITH_SQL = sorted(n for n, e in CATALOGUE.items() if e.sql)
ROWS_ONLY = sorted(n for n, e in CATALOGUE.items() if not e.sql)


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, folder, duck, name):
    assert differences(CATALOGUE[name].build(spark, folder), duck, CATALOGUE[name].sql) == []


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_has_rows(spark, folder, name):
    assert CATALOGUE[name].build(spark, folder).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).limit(1).count() == 1
