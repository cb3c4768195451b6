"""Hand-made frames for edges, invariants of operators that SQL does not check."""

import datetime
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyard.functions import scalars as s
from tallyard.operators import causal, events, metrics, models, pairing, sequence, shift, stats, windows
from tallyard.plans import join_queries, window_queries
from tallyard.sources import readers


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bin_edges_and_null(spark):
    df = spark.createDataFrame([(None,), (0.9,), (1.0,), (1.5,), (2.0,)], "x double")
    assert [r[0] for r in df.select(s.bin_by("x", [1, 2], ["a", "b", "c"])).collect()] == [None, "a", "b", "b", "c"]
    assert [r[0] for r in spark.createDataFrame([(-0.1,), (0.0,), (0.1,), (0.999,), (1.0,)], "p double").select(s.decile("p")).collect()] == [0, 0, 1, 9, 9]


def test_versions(spark):
    df = spark.createDataFrame([("14.10.1",), ("14.9",), ("x",), (None,)], "v string").select(s.version_key("v").alias("k"), s.version_text("v").alias("t")).collect()
    assert [tuple(r.k) if r.k else None for r in df] == [(14, 10), (14, 9), None, None] and df[1].t < df[0].t


def test_auc_ties_and_one_class(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.2, 0), (0.9, 1)], "p double, y int")
    assert metrics.auc(df, "p", "y").first()[0] == 0.875
    assert metrics.auc(df.withColumn("p", F.lit(1.0)), "p", "y").first()[0] == 0.5
    assert metrics.auc(df.filter("y = 1"), "p", "y").first()[0] is None
    assert metrics.regression_metrics(df.withColumn("z", F.lit(1.0)), "z", "p").first()["r2"] is None


def test_auc_over_ranges_against_all_pairs(spark):
    rng = np.random.default_rng(11)
    data = [(("a", "b", None)[int(g)], float(p) if k % 9 else None, int(y)) for k, (g, p, y) in enumerate(zip(rng.integers(0, 3, 900), rng.normal(size=900).round(2), rng.integers(0, 2, 900)))]
    df = spark.createDataFrame(data, "g string, p double, y int")

    def brute(some):
        up, down = ([-math.inf if p is None else p for _, p, y in some if y == k] for k in (1, 0))
        return np.mean([(a > b) + 0.5 * (a == b) for a in up for b in down])

    for ranges in (2, 7, 256):
        assert abs(metrics.auc(df, "p", "y", ranges=ranges).first()[0] - brute(data)) < 1e-9
        got = {r.g: r.auc for r in metrics.auc(df, "p", "y", ["g"], ranges).collect()}
        assert got.keys() == {"a", "b", None} and all(abs(got[g] - brute([r for r in data if r[0] == g])) < 1e-9 for g in got)


def test_within_slope_needs_variation(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 3.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, 1.0), ("d", None, 1.0), ("d", 2.0, 1.0)], "g string, x double, y double")
    assert tuple(causal.within_slope(df, "g", "x", "y", 1).first()) == (1, 2, 2.0)
    assert causal.within_slope(df, "g", "x", "y", 10).first()["slope"] is None


def test_two_way_means_vanish(spark):
    df = spark.createDataFrame([(i % 5, i % 7, float(i % 5 + 2 * (i % 7) + (i * 37 % 11)), float(3 * (i * 37 % 11) + i % 5 - i % 7)) for i in range(200)], "a int, b int, x double, y double")
    assert abs(causal.fe_slope(df, ["a", "b"], "x", "y", tol=1e-12).first()["slope"] - 3) < 1e-6
    assert abs({r.term: r.coefficient for r in causal.ols(df.withColumn("z", 2 * F.col("x") + 1), "z", ["x"]).collect()}["x"] - 2) < 1e-9


def test_bootstrap_of_a_constant(spark):
    df = spark.createDataFrame([(k, 2.0) for k in range(20)], "k int, v double")
    r = causal.boot_mean(df, "k", "v", 50).first()
    assert (r["estimate"], r["low"], r["high"], r["n_clusters"]) == (2.0, 2.0, 2.0, 20)


def poisson(seed, keys, reps):
    """The weights of keys in each draw, by Python's own integers."""
    import hashlib

    fifth = lambda x: pow(x, 5, s.PRIME)
    out = []
    for key in keys:
        h = hashlib.md5(f"{seed}|{key}".encode()).hexdigest()
        a, b = int(h[:8], 16) % s.PRIME, int(h[8:16], 16) % s.PRIME
        x = [fifth((fifth((a + r * 1000003) % s.PRIME) + b) % s.PRIME) for r in range(reps)]
        out.append([sum(v >= int(c * s.PRIME) for c in s.POISSON) for v in x])
    return np.array(out, float).T


def test_poisson_weights_are_poisson():
    w = poisson("seed", range(300), 400)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.03 and abs((w == 0).mean() - math.exp(-1)) < 0.01
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01
    assert abs(w.mean(1).std() * 300**0.5 - 1) < 0.1


def test_bootstraps_against_brute_force(spark):
    rng = np.random.default_rng(5)
    data = [(int(k), float(rng.integers(0, 5)), float(rng.normal()), float(rng.integers(0, 4)), int(rng.integers(0, 2))) for k in rng.integers(0, 25, 200)]
    df = spark.createDataFrame(data, "k int, a double, y double, p double, hit int")
    keys = sorted({r[0] for r in data})
    w = poisson("boot", keys, 300)[:, [keys.index(r[0]) for r in data]]
    k, a, y, p, hit = np.array(data).T
    ends = lambda v: np.quantile(v, [0.025, 0.975])
    got = causal.boot_ratio(df, "k", "a", "y", 300).first()
    assert got.n_clusters == len(keys) and abs(got.estimate - a.sum() / y.sum()) < 1e-9 and np.allclose([got.low, got.high], ends((w @ a) / (w @ y)))
    got = causal.boot_r2(df, "k", "y", "p", 300).first()
    n, mean = w.sum(1), (w @ y) / w.sum(1)
    assert np.allclose([got.low, got.high], ends(1 - (w @ (y - p) ** 2) / ((w * (y - mean[:, None]) ** 2).sum(1))))
    got = causal.boot_auc(df, "k", "p", "hit", 300).first()
    order = (p[:, None] > p[None]) + 0.5 * (p[:, None] == p[None])
    wins = [((x * hit) @ order @ (x * (1 - hit))) / ((x * hit).sum() * (x * (1 - hit)).sum()) for x in w]
    assert np.allclose([got.low, got.high], ends(wins))


def test_weights_are_the_numbers_of_the_formula():
    """Bytes, worked out in blocks, at the ends of the range too; draws whose step passes the prime."""
    ends = [0, 1, s.PRIME - 1, s.PRIME - 2, 12345]
    pairs = [(a, b) for a in ends for b in ends]
    a, b = (np.array(v) for v in zip(*pairs))
    got = s.poisson_weights(a, b, 2200)
    cuts = [int(c * s.PRIME) for c in s.POISSON]
    for row, (x, y) in zip(got, pairs):
        for rep in (0, 1, 999, 2147, 2148, 2199):
            n = pow((pow((x + rep * 1000003) % s.PRIME, 5, s.PRIME) + y) % s.PRIME, 5, s.PRIME)
            assert row[rep] == sum(n >= c for c in cuts)
    assert got.dtype == np.uint8


def test_resampled_groups_nulls_and_non_finite_values(spark, monkeypatch):
    """A group of nulls, more groups than a task holds open, values that are null or infinite, and the row of weight 1."""
    monkeypatch.setattr(causal, "OPEN_GROUPS", 2)
    data = [(k, (None, "a", "b", "c")[k % 4], None if k % 5 == 0 else float("inf") if k == 7 else float(k)) for k in range(60)] + [(99, "void", None)]
    df = spark.createDataFrame(data, "k int, g string, v double").repartition(3)
    w = poisson("x", [r[0] for r in data], 20)
    got = {(r.rep, r.g): (r.v, r.rows) for r in causal.resampled(df, "k", ["v"], 20, "x", ["g"], whole=True).collect()}
    assert len(got) == 21 * 5
    for g in (None, "a", "b", "c", "void"):
        own = [(i, r[2]) for i, r in enumerate(data) if r[1] == g]
        for rep in range(-1, 20):
            taken = [(w[rep, i] if rep >= 0 else 1, v) for i, v in own if v is not None and (rep < 0 or w[rep, i])]
            want = sum(n * v for n, v in taken) if taken else None
            assert got[rep, g][0] == want and got[rep, g][1] == (len(own) if rep < 0 else None)


def test_boot_auc_over_ranges_with_a_hot_score_and_nulls(spark):
    rng = np.random.default_rng(11)
    scores = [None, float("nan"), -0.0, 0.0, *rng.normal(size=300).tolist()]
    data = [(int(k), scores[int(s)] if s >= 0 else 0.25, int(rng.integers(0, 2))) for k, s in zip(rng.integers(0, 900, 3000), np.where(rng.random(3000) < 0.4, -1, rng.integers(0, len(scores), 3000)))]
    df = spark.createDataFrame([*data, (1, 0.5, None)], "k int, p double, hit int")
    rank = np.array([-np.inf if p is None else np.inf if p != p else p for _, p, _ in data])
    hit = np.array([h for *_, h in data])
    keys = sorted({r[0] for r in data})
    w = poisson("boot", keys, 40)[:, [keys.index(r[0]) for r in data]]
    order = (rank[:, None] > rank[None]) + 0.5 * (rank[:, None] == rank[None])
    wins = [((x * hit) @ order @ (x * (1 - hit))) / ((x * hit).sum() * (x * (1 - hit)).sum()) for x in w]
    for ranges in (1, 3, 40):
        got = causal.boot_auc(df, "k", "p", "hit", 40, ranges=ranges).first()
        assert np.allclose([got.low, got.high], np.quantile(wins, [0.025, 0.975]))
    assert causal.boot_auc(df.filter("hit = 1"), "k", "p", "hit", 40).first().low is None
    assert causal.boot_auc(df.limit(0), "k", "p", "hit", 40).first().low is None


def test_date_split_modes(spark):
    rng = np.random.default_rng(4)
    day = np.where(rng.random(200) < 0.5, 40, rng.integers(0, 90, 200))  # one date holds half of the contests
    for frac in (0.0, 0.3, 0.55, 0.8, 1.0):
        data = [(f"c{k:03d}", int(t)) for k, t in enumerate(day)] * 2
        df = spark.createDataFrame([*data, ("none", None)], "c string, t int").repartition(5)
        order = sorted(set(data), key=lambda r: (r[1], r[0]))
        after = {c for c, _ in order[int(frac * len(order)) :]}
        got = windows.date_split(df, "c", "t", frac, "row").collect()
        assert len(got) == 401 and {r.c for r in got if r.test} == after and sum(r.test is None for r in got) == 1
        cut = np.quantile(day, frac)
        assert all(r.test == (r.t >= cut) for r in windows.date_split(df, "c", "t", frac, "quantile").collect() if r.t is not None)
    assert windows.date_split(df.limit(0), "c", "t", 0.8, "row").count() == windows.date_split(df.limit(0), "c", "t", 0.8, "quantile").count() == 0
    with pytest.raises(ValueError):
        windows.date_split(df, "c", "t", 0.8, "other")


def test_numbers_of_categories_over_many_tasks(spark):
    values = [f"v{(k * 7919) % 3001:05d}" for k in range(3001)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:50], None, ""]], "v string").repartition(7)
    got = {r.v: r["index"] for r in s.index_categories(df, "v").collect()}
    assert got == {v: k for k, v in enumerate(sorted({*values, ""}))}
    assert s.index_categories(df.limit(0), "v").count() == 0


def test_group_extremes_and_ties(spark):
    df = spark.createDataFrame([("m", "a", 1.0), ("m", "b", 1.0), ("m", "c", 0.0), ("m", "d", 0.0), ("n", "a", None), ("n", "b", 2.0), ("n", None, 9.0), (None, "a", 9.0)], "m string, g string, s double")
    assert sorted(map(tuple, metrics.group_extremes(df, "g", "m", "s").collect())) == [("m", "b", 1.0, "c", 0.0, 1.0), ("n", "b", 2.0, "b", 2.0, 0.0)]


def test_driver_solves_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_CELLS", 2)
    df = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 2.0)], "a string, b string, y double")
    with pytest.raises(ValueError):
        models.fit_pair_ridge(df, "a", "b", "y", 1.0)


def test_intervals_take_a_thousand_draws_of_whole_tables():
    from tallyard.plans import causal_queries as q

    assert q.REPS == 1000


def backfit_by_hand(rows, lam, K, passes):
    items, people = sorted({x for r in rows for x in r[:2]}), sorted({r[2] for r in rows})
    x = np.zeros((len(rows), len(items)))
    for i, r in enumerate(rows):
        x[i, items.index(r[0])] += 1
        x[i, items.index(r[1])] -= 1
    y = np.array([r[4] for r in rows])
    ridge = lambda v: np.linalg.solve(x.T @ x + lam * np.eye(len(items)), x.T @ v)
    theta, phi = ridge(y), {}
    for _ in range(passes):
        left = y - x @ theta
        phi = {e: sum(v for v, r in zip(left, rows) if r[2] == e) / (sum(r[2] == e for r in rows) + K) for e in people}
        theta = ridge(y - np.array([phi.get(r[2], 0) - phi.get(r[3], 0) for r in rows]))
    return dict(zip(items, theta)), phi


def test_backfit_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(f"i{rng.integers(6)}", f"i{rng.integers(6)}", int(rng.integers(30)), int(rng.integers(34)), float(rng.normal())) for _ in range(300)]
    theta, effects = models.backfit(spark.createDataFrame(rows, "a string, b string, e int, o int, y double"), "a", "b", "e", "o", "y", 2.0, 5.0, 3)
    want, phi = backfit_by_hand(rows, 2.0, 5.0, 3)
    assert all(abs(theta[k] - v) < 1e-8 for k, v in want.items())
    got = {r["e"]: r["effect"] for r in effects.collect()}
    assert got.keys() == phi.keys() and all(abs(got[k] - v) < 1e-8 for k, v in phi.items())


def separable(spark, n=600):
    rng = np.random.default_rng(7)
    rows = [(i, float(x), float(z), int(rng.random() < 1 / (1 + math.exp(-2 * x))), int(i % 10)) for i, (x, z) in enumerate(rng.normal(size=(n, 2)))]
    return spark.createDataFrame(rows, "k int, x double, z double, y int, part int")


def logistic(x, y, reg=0.0):
    """Newton's method with Spark's objective: mean log-loss and reg / 2 times the squared standardised coefficients."""
    scale = np.append(0, x.std(0, ddof=1) ** 2)
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + reg * np.diag(scale), x.T @ (p - y) / len(x) + reg * scale * w)
    return w


def test_logistic_models_against_newton(spark):
    df = separable(spark)
    k, x, z, y, part = np.array(df.orderBy("k").collect(), float).T
    w = logistic(np.column_stack([x, z]), y)
    got = {r["term"]: r["coefficient"] for r in models.lr_coefficients(df, ["x", "z"], "y").collect()}
    assert abs(got["x"] - w[1] * x.std(ddof=1)) < 1e-3 and abs(got["z"] - w[2] * z.std(ddof=1)) < 1e-3
    w = logistic(x[:, None], y)
    got = [r["p"] for r in models.lr_response(df, "x", "y", [-1.0, 0.0, 2.0]).orderBy("x").collect()]
    assert np.allclose(got, [1 / (1 + math.exp(-w[0] - w[1] * v)) for v in (-1, 0, 2)], atol=1e-3)
    rank = lambda v: np.mean([(v[i] > v[j]) + 0.5 * (v[i] == v[j]) for i in np.flatnonzero(y) for j in np.flatnonzero(1 - y)])
    assert {r["term"]: round(r["auc"], 9) for r in models.single_auc(df, ["x", "part"], "y").collect()} == {"x": round(rank(x), 9), "part": round(rank(part), 9)}
    nested = {r["model"]: r for r in models.nested_lr(df, F.col("part") < 7, {"one": ["x"], "none": ["z"]}, "y").collect()}
    w, held = logistic(x[part < 7, None], y[part < 7]), part >= 7
    p = 1 / (1 + np.exp(-w[0] - w[1] * x[held]))
    loss = -np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p)))
    assert nested["one"]["n"] == held.sum() and abs(nested["one"]["log_loss"] - loss) < 1e-3 < nested["none"]["log_loss"] - loss
    cv = models.lr_cv(df, "k", ["x"], "y", 5).first()
    assert cv["n"] == 600 and abs(cv["auc"] - rank(x)) < 0.02 and cv["accuracy"] > 0.75


def test_penalty_is_chosen_refitted_and_tested(spark):
    df = separable(spark)
    at = F.col("part")
    rows = models.lr_select(df, at < 5, (at >= 5) & (at < 7), at >= 7, ["x", "z"], "y", [0.01, 10.0]).orderBy("reg").collect()
    k, x, z, y, part = np.array(df.orderBy("k").collect(), float).T
    both = np.column_stack([x, z])

    def loss(reg, fit, on):
        w = logistic(both[fit], y[fit], reg)
        p = 1 / (1 + np.exp(-w[0] - both[on] @ w[1:]))
        return -np.mean(np.where(y[on] == 1, np.log(p), np.log(1 - p)))

    assert [r["best"] for r in rows] == [True, False] and rows[1]["test_n"] is None and rows[0]["test_n"] == (part >= 7).sum()
    assert all(abs(r["log_loss"] - loss(r["reg"], part < 5, (part >= 5) & (part < 7))) < 2e-3 for r in rows)
    assert abs(rows[0]["test_log_loss"] - loss(0.01, part < 7, part >= 7)) < 2e-3


def test_identity_features_are_own_less_other(spark):
    df = spark.createDataFrame([(1, "b", "F"), (1, "a", "F"), (1, "b", "O"), (2, "a", "O"), (2, "a", "O"), (2, None, "F")], "c int, item string, side string")
    wide, names = models.identity_features(df, "c", "item", "side", "F")
    assert len(names) == 2 and sorted(map(tuple, wide.collect())) == [(1, 1.0, 0.0), (2, -2.0, 0.0)]


def test_multinomial_ranks_follow_the_context(spark):
    rows = [(i, [f"t{i % 3}", "common"], f"c{i % 3}" if i % 17 else "c0") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>, label string")
    got = models.multinomial_ranks(df, F.col("k") < 300, "tokens", "label").collect()
    assert len(got) == 100 and sum(r["rank"] == 1 for r in got) > 90 and {r["true"] for r in got} == {"c0", "c1", "c2"}


def test_multinomial_ranks_work_out_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([(i, [f"t{i % 3}", "common"], f"c{i % 3}") for i in range(60)], "k int, tokens array<string>, label string").mapInArrow(counted, "k int, tokens array<string>, label string")
    got = models.multinomial_ranks(df, F.col("k") < 40, "tokens", "label").collect()
    assert len(got) == 20 and seen.value == 60


def test_segments_vote_for_their_class(spark):
    rng = np.random.default_rng(3)
    rows = [(k, f"l{k % 2}", float(k % 2 * 4 + rng.normal()), float(rng.normal())) for k in range(60) for _ in range(3)]
    df = spark.createDataFrame(rows, "k int, label string, x double, z double")
    got = models.segment_classifier(df, F.col("k") % 5 != 0, ["x", "z"], "label", "k").collect()
    assert len(got) == 12 and sum(r["label"] == r["voted"] for r in got) >= 11


def test_materialised_tables_belong_to_their_input(spark, tmp_path):
    for name in "xy":
        spark.range(3 if name == "x" else 5).write.parquet(f"{tmp_path}/{name}")
    made = [readers.materialize(spark.read.parquet(f"{tmp_path}/{name}"), f"file://{tmp_path}/made", {"by": 1}).count() for name in "xyx"]
    assert made == [3, 5, 3]


def test_pair_ridge_normal_equations(spark):
    data = [("a", "b", 3.0), ("b", "a", -2.5), ("a", "c", 1.0), ("c", "b", 0.5), ("b", "c", -1.0)]
    theta = models.fit_pair_ridge(spark.createDataFrame(data, "a string, b string, y double"), "a", "b", "y", 2.0)
    for x in theta:
        g = 2.0 * theta[x] - sum((y - theta[p] + theta[q]) * ((p == x) - (q == x)) for p, q, y in data)
        assert abs(g) < 1e-6
    assert models.fit_pair_ridge(spark.createDataFrame([], "a string, b string, y double"), "a", "b", "y", 2.0) == {}


def test_beta_interval_inverts_the_cdf(spark):
    r = metrics.beta_interval(spark.createDataFrame([(5, 10), (0, 4), (4, 4)], "w int, n int"), "w", "n").collect()
    assert abs(r[0].low - 0.2235) < 2e-3 and abs(r[0].high - 0.7765) < 2e-3  # Jeffreys interval of 5 of 10
    assert r[1].low < 0.001 and abs(r[1].high + r[2].low - 1) < 1e-6 and r[2].high > 0.999
    r = metrics.beta_interval(spark.createDataFrame([(5 * 10**9, 10**10), (0, 10**7), (None, 3)], "w long, n long"), "w", "n").collect()
    assert abs(r[0].low - (0.5 - 0.98e-5)) < 1e-8 and abs(r[0].high - (0.5 + 0.98e-5)) < 1e-8
    assert abs(r[1].high * 2e7 / 5.0239 - 1) < 1e-3  # gamma(1/2) limit: half the 97.5% point of chi-square with one degree
    assert r[2].low is None or math.isnan(r[2].low)


def test_event_matching(spark):
    a = spark.createDataFrame([("t", 1.0), ("t", 1.05), ("t", 3.0), ("u", 2.0)], "k string, t double")
    b = spark.createDataFrame([("t", 1.02), ("t", 3.06), ("v", 1.0)], "k string, t double")
    got = {r.k: (r.hits, r.n_pred, r.n_true) for r in events.event_prf(a, b, "k", "t", 0.07).collect()}
    assert got == {"t": (2, 3, 2), "u": (0, 1, 0), "v": (0, 0, 1)}
    assert {r.f for r in events.event_prf(a, a, "k", "t", 0.01).collect()} == {1.0}
    assert rows(pairing.near(a, b, "k", "t", 0.02001).select("t")) == [(1.0,)]
    assert abs(events.cemgil(b, b, "k", "t").filter("k = 't'").first()["cemgil"] - 1) < 1e-9


def test_p_score_reaches_as_far_as_the_track(spark):
    """At any scale of time; one track is slow, one has equal times, one a single event, one no prediction."""
    times = {"a": [0.0, 1e6, 2e6, 3.5e6], "b": [5.0, 5.0, 5.0], "c": [1.0], "d": [0.0, 3.0]}
    found = {"a": [2e5, 2.1e5, 1.15e6, 1.8e6, 2.2e6, 3e6], "b": [5.0, 5.5], "c": [1.0], "e": [2.0]}
    frame = lambda some: spark.createDataFrame([(k, t) for k, ts in some.items() for t in ts], "k string, t double")
    got = {r.k: (r.n_true, r.n_pred, r.p_score) for r in events.p_score(frame(times), frame(found), "k", "t").collect()}
    assert got == {"a": (4, 6, 4 / 6), "b": (3, 2, 1.0), "c": (1, 1, 0.0), "d": (2, 0, 0.0)}


def test_p_score_query_has_no_cap(spark):
    import statistics

    from tallyard.plans import registry
    from tallyard.plans.panel import event_times

    d = "/root/testdata/sf0.01"
    by = lambda kind: {r.track: sorted(r.secs) for r in event_times(spark, d, kind).groupBy("track").agg(F.collect_list("sec").alias("secs")).collect()}
    true, pred, far = by("click"), by("view"), 0
    for r in registry.queries()["A38_p_score"](spark, d).collect():
        t, p = true.pop(r.track), pred.get(r.track, [])
        reach = 0.2 * statistics.median([y - x for x, y in zip(t, t[1:])]) if len(t) > 1 else -1
        far += reach > 43200
        assert abs(r.p_score - sum(abs(x - y) <= reach for x in t for y in p) / max(len(t), len(p))) < 2e-6
    assert not true and far == 21


def test_plateau_and_gap(spark):
    v = [0, 1, 5, 5, 5, 1, 4, 0, 9, 0]
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "s string, f int, v double")
    assert rows(windows.peaks(df, "s", "f", "v", 2, 1).select("frame")) == [(3,), (6,), (8,)]
    assert rows(windows.peaks(df, "s", "f", "v", 2, 3).select("frame")) == [(3,), (8,)]


def test_rank_split_cuts_inside_a_tied_time(spark):
    df = spark.createDataFrame([(1, k) for k in range(10)], "t int, k int")
    out = windows.rank_split(df, "t", 0.3, ["k"])
    assert rows(out.filter("test").select("k")) == [(7,), (8,), (9,)]


def test_half_life_and_single_item_period(spark):
    df = spark.createDataFrame([(1, "a")] * 4 + [(2, "a"), (2, "a"), (2, "b"), (2, "b")] + [(3, "b")] * 4, "p int, i string")
    t = shift.tvd_pairs(df, "p", "i", 1)
    assert rows(t.select("p_a", "p_b", "tvd")) == [(1, 2, 0.5), (1, 3, 1.0), (2, 3, 0.5)]
    assert tuple(shift.half_life(t, "p_a", 0.5).first()) == (1, 2.0, 2.0)


def test_pairs_need_both_sides(spark):
    df = spark.createDataFrame([(1, "x", "top", 5), (1, "y", "top", 3), (1, "x", "mid", 1), (2, "x", "top", 1)], "c int, s string, r string, y int")
    assert rows(pairing.pair_opponents(df, "c", "s", "r", ["y"]).select("s", "y_diff")) == [("x", 2), ("y", -2)]
    assert rows(stats.complete_contests(df, "c", "s", "r", ["top"])) == []


def test_candidates_leave_out_taken_items(spark):
    p = spark.createDataFrame([(1, 1, 1, 0, "e", "r", "a"), (2, 2, 1, 1, "e", "r", "b"), (2, 2, 2, 1, "f", "r", "a"), (3, 3, 1, 2, "e", "r", "a")], "contest int, seq long, slot int, week int, entity string, role string, item string")
    pools = {"role": sequence.Pool(["role"], sequence.decayed_cells(p, ["role"], 0.5), 5), "own": sequence.Pool(["entity"], sequence.decayed_cells(p, ["entity"], 0.5), None)}
    walk = sequence.walk_forward(p, pools)
    of = {(r.contest, r.slot): {x["item"]: (round(x["role"], 6), round(x["own"], 6)) for x in r.cands if x["role_in"] or x["own_in"]} for r in walk.collect()}
    assert of[2, 2] == {"a": (1.0, 0.0)}
    assert of[3, 1] == {"a": (round(3 / 5, 6), round(1 / 3, 6)), "b": (round(2 / 5, 6), round(2 / 3, 6))}
    ranks = sequence.rank_settings(walk, [sequence.Setting("0", alpha=0.0), sequence.Setting("1", alpha=1.0)]).filter("contest = 3").collect()
    assert {r.setting: r["rank"] for r in ranks} == {"0": 1, "1": 2}


def test_sources(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "set_a.beats").write_text("0.5 1\n1.0 2\nbad\n")
    (tmp_path / "x" / "y" / "jazz.001.wav").write_bytes(b"12345")
    assert rows(readers.read_event_text(spark, f"{tmp_path}/x/*.beats", "set_")) == [("a", 0.5), ("a", 1.0)]
    assert rows(readers.list_media(spark, str(tmp_path)).select("track", "length")) == [("jazz_001", 5)]
    df = spark.range(3)
    readers.materialize(df, f"file://{tmp_path}/m", {"k": 1})
    assert readers.materialize(df.filter("id < 0"), f"file://{tmp_path}/m", {"k": 1}).count() == 3
    with pytest.raises(Exception, match="no prediction"):
        s.with_default(df, df.filter("id < 2").withColumn("c", F.lit(1)), "id", "c", 0, fail_on_missing=True).collect()


def test_entropy_of_one_item(spark):
    r = stats.concentration(spark.createDataFrame([("g", "a")] * 3, "g string, i string"), ["g"], "i").first()
    assert (r.entropy, r.effective_pool, r.top_share) == (0.0, 1.0, 1.0) and math.isclose(r.n, 3)


def test_contests_lie_compressed_and_move_only_wanted_frames(spark, tmp_path):
    who = lambda k: {"participantId": k, "puuid": f"p{k}", "championName": "c", "teamId": 100, "teamPosition": "MID", "win": True, "kills": 1, "deaths": 2, "assists": 3}
    frame = lambda m: {"participantFrames": {str(k): {"totalGold": 10 * k + m, "xp": m, "minionsKilled": m, "jungleMinionsKilled": 1} for k in (1, 2)}}
    matches = [json.dumps({"metadata": {"matchId": i}, "info": {"participants": [who(1), who(2)]}}) for i in ("a", "b", "c", "d")]
    timelines = [json.dumps({"metadata": {"matchId": i}, "info": {"frames": [frame(m) for m in range(n)]}}) for i, n in (("a", 20), ("b", 12), ("c", 0))]
    for name, lines in (("m", matches), ("t", timelines)):
        readers.write_lines(spark.createDataFrame([(x,) for x in lines], "value string"), f"file://{tmp_path}/{name}")
    assert {p.suffix for n in "mt" for p in (tmp_path / n).glob("part-*")} == {".gz"}
    got = readers.read_contests(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/t")
    want = {"a": (20, 24, 15), "b": (20, 21, 12), "c": (None, None, None), "d": (None, None, None)}  # of participant 1
    assert rows(got.filter("puuid = 'p1'").select("match_id", "gold10", "gold14", "cs14")) == sorted([(i, *v) for i, v in want.items()], key=str)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "info.frames" not in plan.split("Join")[0]  # above the join


def test_at_offset_with_an_order_of_its_own(spark, tmp_path):
    """Part keys of a million and more spill into the line number's place in the order, and cut no line off."""
    lines = [(1, 1, 5, 7.0), (1, 3, 1_200_000, 8.0), (1, 4, 9, 9.0), (2, 2, 1_500_000, 1.0), (2, 3, 100, 2.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    assert rows(join_queries.at_offset(spark, f"file://{tmp_path}")) == [(1, 8.0), (2, 1.0)]


def test_a_plateau_is_no_local_maximum(spark, tmp_path):
    """Two hours of one level: the SQL's strict comparison leaves both out."""
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    data = [(7, at(h), v) for h, v in enumerate([1.0, 40.5, 40.5, 1.0, 30.0, 2.0, 19.0, 3.0])]
    spark.createDataFrame(data, "user_id long, ts timestamp, value double").write.parquet(f"file://{tmp_path}/events.parquet")
    assert rows(window_queries.local_maxima(spark, f"file://{tmp_path}")) == [(7, 4, 30.0)]


def test_two_way_slope_joins_move_no_cells(spark):
    """The cells are dealt once by the first grouping: with joins by sorting, each round shuffles effects and not cells."""
    from pyspark.sql import functions as F

    df = spark.range(6000).select((F.col("id") % 500).alias("a"), (F.col("id") * 7 % 11).alias("b"), F.rand(1).alias("x")).withColumn("y", 3 * F.col("x") + F.col("a") - 2 * F.col("b"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    taken, real = [], type(df).persist
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    type(df).persist = lambda self, level: taken.append(real(self, level)) or taken[-1]
    try:
        got = causal.fe_slope(df, ["a", "b"], "x", "y", tol=1e-12).first()
    finally:
        type(df).persist = real
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got["n_rows"] == 6000 and abs(got["slope"] - 3) < 1e-6
    assert len(taken) == 1 and "hashpartitioning(a" in taken[0]._jdf.queryExecution().executedPlan().toString()
    assert not taken[0].storageLevel.useDisk  # given back
