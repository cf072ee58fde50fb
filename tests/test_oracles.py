"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from notegraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def shown(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, db, name):
    got = QUERIES[name](spark, sf)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    place = {c: k for k, c in enumerate(want.columns)}
    a = sorted(tuple(shown(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(shown(r[place[c]]) for c in order) for r in want.fetchall())
    assert a == b
