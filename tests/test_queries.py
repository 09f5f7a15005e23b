"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from veritrace.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = [tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()]
    assert sorted(names) == columns
    assert sorted(map(repr, rows)) == sorted(repr(tuple(plain(r[c]) for c in columns)) for r in got.collect())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
