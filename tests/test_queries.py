"""Each query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from tallyforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 6) if math.isfinite(float(v)) else None


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    names = sorted(df.columns)
    want = db.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == names
    ours = sorted(([plain(v) for v in r] for r in df.select(*names).collect()), key=repr)
    theirs = sorted(([plain(v) for v in r] for r in want.select(*(f'"{c}"' for c in names)).fetchall()), key=repr)
    assert ours == theirs
