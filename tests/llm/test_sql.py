"""Queries that SQL expresses, against DuckDB."""

import glob
import os

import duckdb
import pytest

from lorikeet.llm import entry

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, sf_dir), con.sql(ORACLES[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda names, rs: sorted((tuple(r[names.index(c)] for c in order) for r in rs), key=repr)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
