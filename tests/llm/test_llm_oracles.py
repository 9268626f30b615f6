import pytest

from tabulon.llm.registry import ORACLE, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf, name):
    assert_same(QUERIES[name](spark, sf), ORACLE[name], sf)
