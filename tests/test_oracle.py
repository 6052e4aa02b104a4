"""Every registered query against its DuckDB form on the smallest tables."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.registry.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def value(x):
    if isinstance(x, float) and not isinstance(x, bool):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (dt.date, dt.datetime)):
        return str(x)
    if hasattr(x, "as_integer_ratio") and not isinstance(x, (bool, int)):
        return round(float(x), 6)
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = entry.registry.QUERIES[name](spark, DATA)
    found = got.collect()
    sql = entry.registry.ORACLE_SQL.get(name)
    if sql is None:
        assert found
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, found) == rows(names, cur.fetchall())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "subject_id" and out.count() > 0


def test_names():
    assert {*entry.oracle_sql()} <= {*entry.queries()}
