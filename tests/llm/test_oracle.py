import pytest

from leafmill.llm.queries import QUERIES, SQL
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(SQL))
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query_equals_its_sql(spark, name, sf):
    assert_same(QUERIES[name](spark, f"/root/testdata/sf{sf}"), SQL[name], f"/root/testdata/sf{sf}")
