import os

import pytest

from larkspur.llm import catalog
from tests.compare import DATA, connection, rows

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert rows(catalog.queries()[name](spark, DATA).toPandas()) == rows(connection().sql(catalog.oracle_sql()[name]).df())
