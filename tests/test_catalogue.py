"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import math
import os
import re

import pytest

from quarrywork.plans import catalogue

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, duck, name):
    df = catalogue.queries()[name](spark, DIR)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(df.columns)
    got = sorted([tuple(norm(r[c]) for c in order) for r in rows])
    assert got == sorted([tuple(norm(r[columns.index(c)]) for c in order) for r in want.fetchall()])


def test_flagship(spark):
    assert catalogue.flagship(spark, DIR).count() == 3


def test_pushed_down_columns(spark):
    plan = catalogue.queries()["strategy_solve_rate"](spark, DIR)._jdf.queryExecution().toString()
    read = re.search(r"ReadSchema: struct<([^>]*)>", plan)[1]
    assert "ts" not in re.findall(r"(\w+):", read)
