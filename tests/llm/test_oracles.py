"""Each query with a DuckDB form against it, on whole small tables."""

from pathlib import Path

import duckdb
import pytest

from nephrolake.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, DATA).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(cur.fetchall())
