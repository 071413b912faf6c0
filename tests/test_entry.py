"""The registered queries against their SQL twins, on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparkweft import queries as library

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(library.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = library.queries()[name](spark, SF), con.sql(library.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert normal(map(tuple, df.collect()), df.columns) == normal(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
