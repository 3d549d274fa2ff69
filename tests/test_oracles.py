"""Every query with SQL gives DuckDB's rows; every query runs."""

import math

import duckdb
import pytest

from cadastra import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(plans.queries())


def shown(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.6g}"
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, con, name):
    df = plans.queries()[name](spark, sf)
    rows, sql = df.collect(), plans.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    cols, expected = [c[0] for c in found.description], found.fetchall()
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    ours = sorted((tuple(shown(r[c]) for c in order) for r in rows), key=str)
    assert ours == sorted((tuple(shown(r[cols.index(c)]) for c in order) for r in expected), key=str)
