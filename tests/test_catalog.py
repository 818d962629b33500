import os

import pytest

import __spark_entry__ as entry
from larkspur import catalog
from tests.compare import DATA, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    return connection()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["o_orderstatus", "n", "total", "mean"] and out.count() > 0
    assert {*entry.oracle_sql()} <= {*entry.queries()}


def test_flagship_reads_two_columns_behind_a_pushed_filter(spark):
    plan = entry.entry(spark)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice,100000.0)" in plan and "ReadSchema: struct<o_orderstatus:string,o_totalprice:double>" in plan
