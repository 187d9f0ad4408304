"""Every query with an oracle gives the same rows as DuckDB, and every other one runs."""

import math

import duckdb
import pytest

from bitloom.plans import catalog, copies, formats, placed, related, values  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return ("inf" if v > 0 else "-inf") if math.isinf(v) else round(v, 3) + 0.0
    return v


@pytest.mark.parametrize("name", list(catalog.ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf)
    want = con.sql(catalog.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in cols]
    expected = sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert rows == expected and rows


@pytest.mark.parametrize("name", [k for k in catalog.QUERIES if k not in catalog.ORACLE_SQL])
def test_runs(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0
