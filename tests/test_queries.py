import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from passagemill.plans import queries as base

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(base.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    want = duck.sql(base.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_queries_without_sql_run(spark):
    for name in set(base.QUERIES) - set(base.ORACLES):
        assert base.QUERIES[name](spark, SF).count()


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    plan = base.search_scoped(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema" in plan and "Python" not in plan and "Exchange" not in plan
