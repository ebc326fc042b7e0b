"""Every timeline query against its SQL on the smallest tables."""

import duckdb
import pytest

from reelspan.catalog import ORACLES, QUERIES
from reelspan.plans.fixtures import BASE


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda row: tuple((v is None, str(v)) for v in row))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, small, duck, name):
    found = QUERIES[name](spark, small)
    columns = sorted(found.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert in_order(found.select(columns).collect()) == in_order(want)


def test_entry_module(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(ORACLES) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
