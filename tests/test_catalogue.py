import pytest

from claimloom.plans import catalogue
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_its_sql(spark, name):
    assert compare(spark, SF, catalogue.queries()[name], catalogue.oracle_sql()[name]) > 0
