"""Every registered query against its SQL on the smallest data."""

import pytest

import __spark_entry__ as entry
from assaylake.verification import catalog, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    assert compare.differences(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
