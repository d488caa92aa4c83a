"""Every query with SQL against that SQL, and every other one for its rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from corpusflow.plans import registry
from corpusflow.session import TABLES

ROOT = "/root/testdata/sf0.001"
QUERIES = {n: q for m in registry.MODULES for n, q in m.QUERIES.items()}
SQL = {n: s for m in registry.MODULES for n, s in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not Path(ROOT).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{ROOT}/{t}.parquet')")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "-"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, ROOT)
    got = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        want = sorted(tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in found.fetchall())
        assert sorted(df.columns) == sorted(names) and got == want


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
