"""Every registered query against DuckDB on the same tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = queries(), oracle_sql()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    got = _rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in SQL:
        assert got[1], "no rows"
        return
    result = duck.execute(SQL[name])
    want = _rows([d[0] for d in result.description], result.fetchall())
    assert got[0] == want[0]
    missing = [r for r in want[1] if r not in set(got[1])][:3] if len(want[1]) < 20000 else []
    extra = [r for r in got[1] if r not in set(want[1])][:3] if len(want[1]) < 20000 else []
    assert (len(got[1]), missing, extra) == (len(want[1]), [], [])
    assert got[1] == want[1]
