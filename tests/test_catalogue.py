"""Every registered query against its SQL, as the driver compares them."""

from __future__ import annotations

import duckdb
import pytest

from citeplane.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sql, name):
    df = catalogue.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(tuple(map(str, (r[c] for c in names))) for r in df.collect())
    if name not in catalogue.SQL:
        assert got
        return
    want = sql.sql(catalogue.SQL[name])
    columns = want.columns
    assert sorted(columns) == names
    assert got == sorted(tuple(map(str, (r[columns.index(c)] for c in names))) for r in want.fetchall())


def test_contract():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
