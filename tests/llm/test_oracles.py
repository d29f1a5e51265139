"""Every query of this subpackage with SQL gives the rows of its SQL in DuckDB on the smallest tables."""

import collections
import glob
import os

import duckdb
import pytest

from lodestone.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = queries()[name](spark, sf), con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = collections.Counter(tuple(r[c] for c in want.columns) for r in df.collect())
    assert got and got == collections.Counter(want.fetchall())
