import pytest

from stagewise.plans import asked, bindings, reruns, shows  # noqa: F401  they register queries
from stagewise.plans.registry import QUERIES, SQL
from tests.conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    assert rows_of(got) == rows_of(duck.sql(SQL[name]).df())


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
