"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__
from depotflow.catalog import QUERIES
from tests.compare import difference, duck, spark_rows, sql_rows
from tests.conftest import SF

SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    problem = difference(spark_rows(QUERIES[name](spark, SF)), sql_rows(connection, SQL[name]))
    assert problem is None, problem


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "item_id"


def test_rows_come_back_in_the_order_of_the_list(spark):
    shortage = [r.shortage_quantity for r in __spark_entry__.entry(spark).collect()]
    assert shortage == sorted(shortage, reverse=True)
    orders = [r.so_id for r in QUERIES["sales_order_full"](spark, SF).collect()]
    assert orders == sorted(orders, reverse=True)
