"""Every registered query against its SQL in DuckDB, or for its rows where SQL cannot express it."""

import os

import duckdb
import pytest

from tests.conftest import SF, SF01
from tidewright import catalog


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS FROM '{SF}/{f}'")
    return c


def close(a, b):
    if isinstance(a, float) and isinstance(b, (int, float)):
        return abs(a - b) <= 2e-4 * max(1.0, abs(a) * 1e-6)
    return a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    rows = catalog.queries()[name](spark, SF).collect()
    assert rows and all(r["exception"] is None for r in rows if "exception" in r.__fields__)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    rel = con.sql(catalog.oracle_sql()[name])
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    assert [rel.columns[i] for i in order] == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    expect = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=key)
    got = sorted(got, key=key)
    assert len(got) == len(expect) and len(got) > 0
    bad = [(a, b) for a, b in zip(got, expect) if not all(close(x, y) for x, y in zip(a, b))]
    assert not bad, bad[:3]


def test_companding_round_trip_to_the_last_digit(spark):
    """Balances on rounding borders too: equal, not close."""
    df = catalog.queries()["scalar_companding_round_trip"](spark, SF01)
    expect = duckdb.sql(catalog.oracle_sql()["scalar_companding_round_trip"].replace("customer", f"'{SF01}/customer.parquet'")).fetchall()
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["c_custkey", "mu", "a"] and len(got) == len(expect) and sorted(got) == sorted(expect)
