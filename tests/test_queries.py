"""Every registered query with oracle SQL against DuckDB on sf0.01."""

import decimal
import math

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from weftline.plans.inputs import TABLES
from weftline.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, np.floating, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 6)
    return v


def rows_of(rows):
    return sorted((tuple(plain(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q[1]))
def test_against_oracle(spark, duck, name):
    df = QUERIES[name][0](spark, SF)
    cols = sorted(df.columns)
    got = rows_of(tuple(r[c] for c in cols) for r in df.collect())
    done = duck.execute(QUERIES[name][1])
    names = [d[0] for d in done.description]
    assert sorted(names) == cols
    want = rows_of(tuple(r[names.index(c)] for c in cols) for r in done.fetchall())
    assert got and got == want


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if not q[1]))
def test_runs(spark, name):
    assert QUERIES[name][0](spark, SF).limit(1).count() == 1


def test_entry(spark):
    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())
