"""Every registered query of the library: against its SQL where there is one, else that it gives rows."""

import pytest

from tessera import catalogue

from .oracle import check, connect

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        check(df, con, SQL[name])
    else:
        assert df.count() > 0


def test_queries_over_whole_orders(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    for name in ("parent_attachment", "step_status", "admin_conversation"):
        assert QUERIES[name](spark, sf_dir).count() == orders
