import pytest

from clickloom.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, catalog.queries()[name], catalog.oracle_sql()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_others_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
