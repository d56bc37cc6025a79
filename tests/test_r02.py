"""Queries that a reviewer found to differ from their SQL, on small tables that show it."""

import duckdb
import pytest

from tabulon.queries import QUERIES, SQL
from test_queries import plain


@pytest.fixture
def agrees(spark, tmp_path):
    """Whether a query over events (as SQL rows) gives what its SQL gives."""

    def check(name, events):
        con = duckdb.connect()
        con.execute(f"COPY ({events}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
        assert sorted(tuple(map(plain, r)) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want)
        return len(want)

    return check


@pytest.mark.parametrize(
    "values",
    [
        "(12345678.9, 3), (2.5, 1)",  # above 1e7 Spark writes exponents
        "(1e15, 9), (0.00000499, 1)",
        "(1e-5, 5), (-0.00003, 1)",
        "(NULL, 1), (2.0, NULL), (0.00005, 1)",
        "('inf'::DOUBLE, 2), (1.0, 1)",
        "('nan'::DOUBLE, 2), (1.0, 1)",
        "(NULL::DOUBLE, 1)",  # a sum of nothing is null
    ],
)
def test_series_dot_text(agrees, values):
    assert agrees("series_dot", f"SELECT row_number() OVER () AS event_id, v::DOUBLE AS value, u::BIGINT AS user_id FROM (VALUES {values}) t(v, u)") == 2


def test_at_time_within_the_second(agrees):
    times = "('2024-01-01 10:00:00'), ('2024-01-02 10:00:00.25'), ('1960-02-29 10:00:00.999999'), ('2024-01-01 09:59:59.999999'), ('2024-01-01 10:00:01'), ('2024-01-01 22:00:00'), (NULL)"
    assert agrees("at_time", f"SELECT row_number() OVER () AS event_id, s::TIMESTAMP AS ts FROM (VALUES {times}) t(s)") == 3


def test_arithmetic_on_odd_values(agrees):
    rows = "(1, 'inf'), (2, 'nan'), (3, '1e300'), (4, '1e19'), (5, '5e-324'), (-7, '3.5'), (-5, '2.0'), (6, NULL), (NULL, '7.5'), (9, '9007199254740993.0'), (5, 'nan'), (8, '-inf')"
    assert agrees("arithmetic", f"SELECT i::BIGINT AS event_id, v::DOUBLE AS value FROM (VALUES {rows}) t(i, v)") == 10
