"""Every registered query with SQL gives the SQL's rows; on smaller tables some groups that they need are empty."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import tallyard.plans.registry as registry

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def test_entry_needs_no_session():
    """The driver lists queries and SQL before it starts Spark."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=here, check=True)


def test_every_query_is_registered():
    assert len(QUERIES) > 140 and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(SQL[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: str(tuple(r))
    want = sorted((tuple(shown(v) for v in r) for r in cur.fetchall()), key=key)
    got = sorted((tuple(shown(r[c]) for c in cols) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-4, abs_tol=1e-4)) for x, y in zip(a, b)), (a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
