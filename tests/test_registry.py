import pytest

from quillmere.plans import catalog
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.SQL[name], SF)
