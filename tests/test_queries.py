"""Every registered query against its SQL on the smallest shared tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from check_oracles import TABLES, rows_of

QUERIES, SQL = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[0] or name in {"prefix_size_and_count"}
    if name in SQL:
        cur = con.execute(SQL[name])
        assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
