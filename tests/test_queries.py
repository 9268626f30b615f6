import pytest

import __spark_entry__ as driver
from tabulon.plans.queries import ORACLE, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE:
        assert_same(df, ORACLE[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() == 20
    assert set(driver.oracle_sql()) <= set(driver.queries())
