"""Driver contract: entry() and every SQL-checked query against DuckDB on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from fluvio.queries import ORACLES, QUERIES
from fluvio.sources.tables import TABLES

SLOW = {"train_eval"}


def test_entry_smoke(spark, sf_small):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert {"station_id", "coverage", "nse", "risk"} <= set(df.columns)


def test_every_query_has_callable():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(o) >= 40


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if round(v, 6) == 0 else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, sf_small, duck, name):
    df = E.queries()[name](spark, sf_small)
    s_cols = df.columns
    s_rows = sorted(repr(tuple(_norm(r[c]) for c in sorted(s_cols))) for r in df.collect())
    res = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    idx = sorted(range(len(o_cols)), key=lambda i: o_cols[i])
    o_rows = sorted(repr(tuple(_norm(r[i]) for i in idx)) for r in res.fetchall())
    assert sorted(s_cols) == sorted(o_cols)
    assert s_rows == o_rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_rows_only_queries_run(spark, sf_small, name):
    assert E.queries()[name](spark, sf_small).count() >= 0
