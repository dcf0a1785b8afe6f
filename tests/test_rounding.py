"""Rounding of doubles to six places, against DuckDB's."""

import math

import duckdb

from lorikeet.plans import catalog

#: A first session of 0.1 over five attempts and one of 0.5 over four, 47 weeks
#: later: the slope, 0.105 / 48, lies next to a half at six places.
SESSIONS = {0: ("2000-08-28", (0.0, 0.0, 0.0, 0.0, 0.01)), 1: ("2001-07-23", (0.0, 0.0, 0.0, 0.05))}


def test_values_next_to_a_half(spark):
    near = [k / n for n in (128, 640, 3200) for k in range(1, n, 2)]
    near += [math.nextafter(x, to) for x in near for to in (0.0, 1.0)]
    values = [*near, *[-x for x in near], 0.0, 0.3, 1e12 + 0.0000015, 1e300, 1e305, math.inf, -math.inf, math.nan, None]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = {r["i"]: r["x"] for r in catalog.rounded(rows).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE v (i INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO v VALUES (?, ?)", list(enumerate(values)))
    want = dict(con.sql("SELECT i, round(x, 6) FROM v").fetchall())
    assert {i: repr(None if x is None else x + 0.0) for i, x in got.items()} == {i: repr(None if x is None else x + 0.0) for i, x in want.items()}


def test_a_trend_next_to_a_half(spark, sf_dir, tmp_path):
    con = duckdb.connect()
    customer, orders, lineitem = (f"SELECT * FROM '{sf_dir}/{t}.parquet'" for t in ("customer", "orders", "lineitem"))
    con.execute(f"CREATE TABLE customer AS {customer} WHERE c_custkey = 1")
    con.execute(f"CREATE TABLE orders AS {orders} LIMIT 0")
    con.execute(f"CREATE TABLE lineitem AS {lineitem} LIMIT 0")
    for key, (day, scores) in SESSIONS.items():
        con.execute(f"INSERT INTO orders BY NAME SELECT {key} AS o_orderkey, 1 AS o_custkey, TIMESTAMP '{day}' AS o_orderdate")
        for n, x in enumerate(scores):
            con.execute(f"INSERT INTO lineitem BY NAME SELECT {key} AS l_orderkey, {n} AS l_linenumber, {x}::DOUBLE AS l_discount, 0.01::DOUBLE AS l_tax")
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    name = "progress_trend_365d"
    want = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, str(tmp_path)).select(*want.columns).collect()
    assert [tuple(r) for r in got] == want.fetchall() == [(1, 48, "improving", 0.002188, 0.125, 0.02)]
