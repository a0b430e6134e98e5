import pytest

import __spark_entry__
from millrace import registry
from millrace.operators import testing

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    assert testing.compare(spark, FOLDER, registry.QUERIES[name], registry.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_has_rows(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_entry(spark):
    assert 0 < __spark_entry__.entry(spark).count() <= 10
