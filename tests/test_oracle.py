import pytest

from leafmill.plans.registry import QUERIES
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in QUERIES.items() if sql))
def test_query_equals_its_sql(spark, name):
    query, sql = QUERIES[name]
    assert_same(query(spark, SF), sql, SF)
