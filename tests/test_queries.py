"""Every registered table query against its SQL in DuckDB."""

import datetime
import math

import duckdb
import pytest

from tabulon.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}" if abs(v) > 1e-12 else "0"
    if isinstance(v, (bool, int)):
        return str(v) if isinstance(v, bool) else f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    if name not in SQL:
        assert got.count() > 0
        return
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in got.select(*[f"`{n}`" for n in names]).collect()) == want
