"""Fits side by side against fits of their own, boosted trees against exhaustive splits."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.operators import boosting as bo
from tallyard.operators import fits


def newton(x, y, lam):
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([0.0] + [lam] * (x.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


@pytest.fixture(scope="module")
def matches(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 2)) * [1, 3]
    y = (rng.random(900) < 1 / (1 + np.exp(-(0.4 + 1.2 * x[:, 0] - 0.3 * x[:, 1])))).astype(int)
    days = np.arange(900) // 9
    rows = [(int(d), datetime.date(2024, 1, 1) + datetime.timedelta(int(d)), f"e{d // 25}", k // 3, float(a), float(b), int(t), float(np.clip(0.5 + a / 8, 0, 1)), 0.4) for k, (d, (a, b), t) in enumerate(zip(days, x, y))]
    return rows, spark.createDataFrame(rows, "d int, day date, event string, contest int, a double, b double, y int, p double, q double").repartition(3)


@pytest.mark.parametrize("lam", [0.0, 1.0])
def test_each_fit_equals_its_own(matches, lam):
    rows, df = matches
    got = fits.logistic_fits(df.withColumn("fits", F.filter(F.array(*map(F.lit, range(5))), lambda k: F.col("d") < 10 + 20 * k)), "fits", 5, ["a", "b"], "y", lam)
    for k in range(5):
        own = [r for r in rows if r[0] < 10 + 20 * k]
        assert np.allclose(got[k], newton(np.array([r[4:6] for r in own]), np.array([r[6] for r in own]), lam), atol=1e-6)


def test_fits_without_rows_or_curvature(spark, matches):
    _, df = matches
    assert fits.logistic_fits(df.filter("false").withColumn("fits", F.array(F.lit(0))), "fits", 1, ["a"], "y") == {}
    apart = spark.createDataFrame([(float(k), int(k > 3), [0], None) for k in range(8)] + [(None, 1, [0], 2.0)], "x double, y int, fits array<int>, z double")
    theta = fits.logistic_fits(apart, "fits", 1, ["x"], "y")[0]  # separable: no optimum, the rounds end
    assert np.isfinite(theta).all() and theta[1] > 1
    assert np.isfinite(fits.logistic_fits(apart, "fits", 1, ["z"], "y")[0]).all()  # one row
    with pytest.raises(ValueError):
        fits.logistic_fits(apart, "fits", fits.MOST_FITS + 1, ["x"], "y")


def test_forward_fits_against_each_cut(matches):
    rows, df = matches
    scores, theta = fits.forward_fits(df, "event", "day", "contest", ["p", "q"], ["a", "b"], "y", reps=400)
    scores, theta = {r["event"]: r for r in scores.collect()}, {r["event"]: r["theta"] for r in theta.collect()}
    assert sorted(scores) == ["e1", "e2", "e3"] == sorted(theta)  # the first event has no past
    right = lambda p, own: np.mean([(a >= 0.5) == (r[6] == 1) for a, r in zip(p, own)])
    for event, r in scores.items():
        held = [x for x in rows if x[2] == event]
        past = [x for x in rows if x[1] < min(h[1] for h in held)]
        w = newton(np.array([x[4:6] for x in past]), np.array([x[6] for x in past]), 1.0)
        assert np.allclose(theta[event], w, atol=1e-6)
        lr = lambda own: 1 / (1 + np.exp(-(w[0] + np.array([x[4:6] for x in own]) @ w[1:])))  # noqa: E731, B023
        acc = [right([x[7] for x in past], past), right([0.4] * len(past), past), right(lr(past), past)]
        mix = (acc[0] * np.array([x[7] for x in held]) + acc[1] * 0.4 + acc[2] * lr(held)) / sum(acc)
        assert (r["n"], r["n_train"], r["n_contests"]) == (len(held), len(past), len({x[3] for x in held}))
        assert abs(r["accuracy"] - right(mix, held)) < 1e-9 and abs(r["brier"] - np.mean([(m - x[6]) ** 2 for m, x in zip(mix, held)])) < 1e-6
        assert abs(r["fitted_accuracy"] - right(lr(held), held)) < 1e-9
        assert r["low"] < r["accuracy"] < r["high"] and r["high"] - r["low"] < 0.2 and r["inside"] == (r["low"] <= 0.5 <= r["high"])


def test_splits_against_all_sets_of_bins():
    rng = np.random.default_rng(1)
    for categorical in (False, True):
        for _ in range(30):
            n, g = np.zeros(bo.BINS), np.zeros(bo.BINS)
            used = rng.choice(bo.BINS, 6, replace=False)
            n[used], g[used] = rng.integers(1, 20, 6), rng.normal(size=6) * 10
            least, l2 = (1, 0.0) if categorical else (8, 0.5)  # a penalty may favour sets out of the order of means
            score = lambda m: g[m].sum() ** 2 / (n[m].sum() + l2)  # noqa: E731, B023
            best = 0.0
            for bits in range(1, 2**6 - 1):
                own = np.isin(np.arange(bo.BINS), used[[k for k in range(6) if bits >> k & 1]])
                if not categorical and not (used[np.isin(used, np.flatnonzero(own))].max() < np.setdiff1d(used, np.flatnonzero(own)).min()):
                    continue
                if min(n[own].sum(), n[~own].sum()) >= least:
                    best = max(best, score(own) + score(~own) - score(np.ones(bo.BINS, bool)))
            got = bo.best_split(n, g, categorical, least, l2)
            assert got is None and best < 1e-6 or abs(got[0] - best) < 1e-9


def test_boosting_learns_and_stops(spark):
    rng = np.random.default_rng(2)
    rows = [(k, f"c{k % 7}" if k % 50 else None, float(k % 11) if k % 31 else None, float(rng.normal())) for k in range(3000)]
    rows = [(k, c, x, z, ((c or "c1") in ("c1", "c4", "c6")) * 8.0 - (x or 0) + 0.2 * z) for k, c, x, z in rows]
    df = spark.createDataFrame([*rows, (9999, "c1", 1.0, 0.0, None)], "k int, c string, x double, z double, y double").repartition(3)
    settings = [bo.Boosting("quick", 0.3, 8, 20, 1.0), bo.Boosting("stump", 0.3, 2, 20, 1.0), bo.Boosting("none", 0.3, 8, 3000, 1.0)]
    got = {r["setting"]: r for r in bo.boost_sweep(df, F.col("k") < 2000, "k", ["c"], ["x"], "y", settings, rounds=40, patience=4).collect()}
    assert got["quick"]["r2"] > 0.97 and got["stump"]["r2"] > 0.9 and got["quick"]["auc"] > 0.98 and got["quick"]["n"] == 1000
    assert got["none"]["trees"] == 0 and got["quick"]["trees"] <= 40


def test_first_tree_against_plain_numpy(spark, monkeypatch):
    rows = [(k, float(k % 10), float((k % 10 >= 6) * 5 + (k % 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "k int, x double, y double").repartition(4)
    out, growers = bo.boost(df, F.lit(True), "k", [], ["x"], "y", [bo.Boosting("s", 1.0, 2, 1, 0.0)], rounds=1, patience=2, validation=0.0)
    [tree] = growers[0].trees
    y = np.array([r[2] for r in rows])
    high = np.array([r[1] >= 6 for r in rows])
    assert len(tree.column) == 3 and sorted(np.round(tree.value[1:], 9)) == sorted(np.round([y[high].mean() - y.mean(), y[~high].mean() - y.mean()], 9))
    assert {round(r["f"][0], 6) for r in out.collect()} == {round(y[high].mean(), 6), round(y[~high].mean(), 6)}
    monkeypatch.setattr(bo, "PENDING", 0)  # scores are stored anew every few trees
    settings = [bo.Boosting("s", 0.1, 2, 1, 0.0)]
    long = bo.boost(df, F.lit(True), "k", [], ["x"], "y", settings, rounds=30, patience=3, validation=0.2)
    monkeypatch.setattr(bo, "PENDING", 10**6)
    once = bo.boost(df, F.lit(True), "k", [], ["x"], "y", settings, rounds=30, patience=3, validation=0.2)
    shown = lambda d: sorted((r["y"], round(r["f"][0], 6)) for r in d.collect())
    assert shown(long[0]) == shown(once[0]) and long[1][0].stored > 0 == once[1][0].stored


def test_boosting_without_rows(spark):
    df = spark.createDataFrame([], "k int, c string, x double, y double")
    assert bo.boost_sweep(df, F.lit(True), "k", ["c"], ["x"], "y", [bo.Boosting("s", 0.1, 4, 1, 1.0)]).count() == 0
    some = spark.createDataFrame([(1, "a", 1.0, 2.0)], "k int, c string, x double, y double")
    out, _ = bo.boost(some, F.lit(False), "k", ["c"], ["x"], "y", [bo.Boosting("s", 0.1, 4, 1, 1.0)])
    assert [r["f"] for r in out.collect()] == [[None]]


def test_logistic_models_read_their_input_once(spark):
    """However many models and rounds there are; rows with a null column or label train nothing."""
    from tallyard.operators import models

    rng = np.random.default_rng(8)
    rows = [(k, float(rng.normal()), float(rng.normal()), int(rng.integers(0, 2))) for k in range(400)] + [(1, None, 1.0, 1), (2, 1.0, 1.0, None)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    df = spark.createDataFrame(rows, "k int, x double, z double, y int").withColumn("x", counted("x"))
    ok = [r for r in rows if None not in r]
    x, y = np.array([r[1:3] for r in ok]), np.array([r[3] for r in ok])
    theta = newton(x, y, 0.0)
    got = {r.term: r.coefficient for r in models.lr_coefficients(df, ["x", "z"], "y").collect()}
    assert np.allclose([got["x"], got["z"]], theta[1:] * x.std(axis=0, ddof=1), atol=1e-8) and abs(got["intercept"] - theta[0] - theta[1:] @ x.mean(axis=0)) < 1e-8
    assert read.value <= 2 * len(rows)  # as a filter and as a column
    own = newton(x[:, :1], y, 0.0)
    assert abs(models.lr_response(df, "x", "y", [0.5]).first().p - 1 / (1 + np.exp(-own[0] - own[1] / 2))) < 1e-8
    read.value = 0
    out = models.nested_lr(df, F.col("k") < 300, {"one": ["x"], "two": ["x", "z"]}, "y").collect()
    assert {r.model: r.n for r in out} == {"one": 100, "two": 100} and read.value <= len(rows)


def test_boosting_reads_its_input_once(spark):
    """However many columns, trees and levels there are; trees give the same nodes as a walk of each row."""
    rng = np.random.default_rng(4)
    rows = [(k, f"c{k % 5}" if k % 9 else None, float(rng.normal()) if k % 7 else None, float(k % 5 + rng.normal())) for k in range(500)]
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    df = spark.createDataFrame(rows, "k int, c string, x double, y double").withColumn("x", counted("x"))
    settings = [bo.Boosting("s", 0.3, 8, 5, 1.0), bo.Boosting("t", 0.3, 2, 5, 1.0)]
    out, growers = bo.boost(df, F.col("k") < 400, "k", ["c"], ["x"], "y", settings, rounds=5, patience=5)
    assert len(out.collect()) == 500 == read.value
    bins = rng.integers(0, bo.BINS, (300, 2)).astype(np.int16)
    for tree in [t for g in growers for t in g.trees]:
        for row, node in zip(bins, tree.nodes(bins)):
            at = 0
            while tree.column[at] >= 0:
                at = tree.left[at] if tree.goes[at][row[tree.column[at]]] else tree.right[at]
            assert at == node
