"""Every query with SQL gives the rows DuckDB gives, at the smallest scale."""

import duckdb
import pytest

from marlstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()
LARGER = {"portfolio_risk", "risk_findings", "risk_sentences", "risk_evidence", "monte_carlo_var"}  # these need hundreds of hours in which every event type occurs


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def con():
    def at(sf):
        c = duckdb.connect()
        c.execute("SET timezone = 'UTC'")
        for t in TABLES:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        return c

    return at


def folder(sf, name):
    return sf.replace("sf0.001", "sf0.01") if name in LARGER else sf


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, sf, con, name):
    sf = folder(sf, name)
    df = registry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    res = con(sf).execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_without_sql_runs(spark, sf, name):
    df = registry.queries()[name](spark, folder(sf, name))
    rows = df.collect()  # every column is worked out, which count() would not do
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
