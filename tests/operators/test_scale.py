"""Quantiles and phases that no single task holds, against numpy and plain windows."""

import random

import numpy as np
import pytest

from tallyard.operators import stats, windows
from tallyard.plans import panel, registry


@pytest.mark.parametrize("ranges,most", [(4096, 4096), (4, 3), (16, 1)])
def test_quantiles_against_numpy(spark, ranges, most, monkeypatch):
    monkeypatch.setattr(stats, "RANGES", ranges)
    monkeypatch.setattr(stats, "SORTED", most)
    rng = random.Random(1)
    groups = {"skewed": [rng.expovariate(1) ** 6 for _ in range(150)], "ties": [1.0] * 60 + [2.0] * 40, "one": [7.0], None: [rng.random() for _ in range(33)], "same": [3.0] * 50, "wide": [-1e15, 0.0, 1e-9, 2e-9, 1e15]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(3)
    got = {r["g"]: r for r in stats.quantiles(df, ["g"], "y", [0.05, 0.5, 0.95]).collect()}
    assert set(got) == set(groups)  # a group without values has no row
    for g, vs in groups.items():
        assert np.allclose([got[g]["q05"], got[g]["q50"], got[g]["q95"]], np.quantile(vs, [0.05, 0.5, 0.95]), rtol=1e-12, atol=1e-18)
    assert stats.quantiles(df.filter("false"), ["g"], "y", [0.5]).count() == 0


@pytest.mark.parametrize("most", [4096, 2])
def test_top_groups_against_numpy(spark, most, monkeypatch):
    """A hot group, a null one, ties (the smaller name first), one below min_n, and one without values, which comes last."""
    monkeypatch.setattr(stats, "RANGES", 4)
    monkeypatch.setattr(stats, "SORTED", most)
    rng = random.Random(3)
    groups = {"hot": [rng.gauss(0, 1) for _ in range(120)], None: [rng.gauss(5, 1) for _ in range(31)], "a": [2.0] * 5, "b": [1.0, 2.0, 2.0, 9.0], "few": [50.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("void", None)] * 4 + [("a", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(3)
    got = [(r["g"], r["n"], r["median"]) for r in stats.top_groups(df, "g", "y", 5, 4).collect()]
    assert [(g, n) for g, n, _ in got] == [(None, 31), ("a", 6), ("b", 4), ("hot", 120), ("void", 4)]
    assert np.allclose([m for *_, m in got[:-1]], [np.median(groups[g]) for g, *_ in got[:-1]], rtol=1e-12) and got[-1][2] is None
    assert [r["g"] for r in stats.top_groups(df, "g", "y", 2, 4).collect()] == [None, "a"]
    assert stats.top_groups(df.filter("false"), "g", "y", 3, 1).count() == 0


def test_phases_against_one_window(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), k) for k in range(80)]
    df = spark.createDataFrame(rows, "g string, t int, k int").repartition(3)
    got = {r["k"]: r["phase"] for r in windows.phase_in_group(df, ["g"], ["t", "k"]).collect()}
    for g in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, r in enumerate(own, 1):
            assert abs(got[r[2]] - n / len(own)) < 1e-12


@pytest.mark.parametrize("name", ["J2_composite_join", "J6_sides_to_wide", "J14_prior_in_series", "P15_signed_features", "P16_context_features", "A6_pick_rate", "A17_lanes_wide"])
@pytest.mark.parametrize("most", [100, 30_000])
def test_large_tables_are_dealt_by_rows(spark, name, most, monkeypatch):
    """A task holds a bounded number of rows, not as many as compress to some size; nothing is lost on the way."""
    import duckdb

    monkeypatch.setattr(panel, "SMALL_ROWS", most)
    monkeypatch.setattr(panel, "TASK_ROWS", 10_000)
    d = "/root/testdata/sf0.01"
    df = registry.queries()[name](spark, d)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part"):
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(tuple(map(str, r)) for r in want.fetchall()) == sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
