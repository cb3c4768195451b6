"""Learned and iterative estimators on aggregated statistics or Spark ML."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import CountVectorizer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import hash_uniform

from tallyard.sources.readers import stored

from .fits import linear, logistic_fits, sigmoid, theta_table
from .metrics import auc, binary_metrics, regression_metrics


#: Most rows (cells of item pairs, or items) that a fit takes to the driver; beyond it a fit stops with an error.
MOST_CELLS = 1_000_000
MOST_ITEMS = 10_000


def bounded(df: DataFrame, most: int, what: str) -> list:
    """The rows of a table that must be small; an error if there are more."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}: too many for a solve on the driver")
    return rows


def solve_pairs(cells: list, lam: float) -> dict[str, float]:
    """theta from cells (a, b, n, s): the counts and sums of y of each ordered pair of items."""
    items = sorted({c[0] for c in cells} | {c[1] for c in cells})
    if len(items) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: too many for a solve on the driver")
    at = {x: i for i, x in enumerate(items)}
    m, v = lam * np.eye(len(items)), np.zeros(len(items))
    for a, b, n, s in cells:
        i, j = at[a], at[b]
        m[i, i] += n
        m[j, j] += n
        m[i, j] -= n
        m[j, i] -= n
        v[i] += s or 0.0
        v[j] -= s or 0.0
    return dict(zip(items, np.linalg.solve(m, v).tolist())) if items else {}


def fit_pair_ridge(df: DataFrame, a: str, b: str, y: str, lam: float) -> dict[str, float]:
    """theta of the ridge fit y = theta[a] - theta[b].

    Spark aggregates the normal equations to one row per pair of items; the driver solves items x items.
    """
    cells = bounded(df.groupBy(a, b).agg(F.count(y).alias("n"), F.sum(y).alias("s")), MOST_CELLS, "pairs of items")
    return solve_pairs([tuple(c) for c in cells], lam)


def pair_ridge(df: DataFrame, a: str, b: str, y: str, lam: float, by: str) -> DataFrame:
    """(by, item, theta): one fit per group of by; all groups come from one aggregate."""
    groups: dict = {}
    for c in bounded(df.groupBy(by, a, b).agg(F.count(y).alias("n"), F.sum(y).alias("s")), MOST_CELLS, "pairs of items"):
        groups.setdefault(c[0], []).append(tuple(c)[1:])
    rows = [(g, item, theta) for g in sorted(groups, key=str) for item, theta in solve_pairs(groups[g], lam).items()]
    return df.sparkSession.createDataFrame(rows, f"{by} {dict(df.dtypes)[by]}, item string, theta double")


def backfit(df: DataFrame, a: str, b: str, entity: str, opp_entity: str, y: str, lam: float, K: float, passes: int = 3) -> tuple[dict[str, float], DataFrame]:
    """y = theta[a] - theta[b] + effect[entity] - effect[opp_entity]: (theta, (entity, effect)).

    theta is the pair ridge; in each pass the effects are the shrunk means of what theta leaves (by own entity), and theta is
    fitted again to what both effects leave.  An entity or item that was not seen counts 0.
    """
    spark = df.sparkSession
    rows = df.select(a, b, entity, opp_entity, y)
    theta, effects = fit_pair_ridge(rows, a, b, y, lam), None
    for _ in range(passes):
        items = spark.createDataFrame([(str(k), v) for k, v in theta.items()], "_i string, _t double")
        own, other = items.toDF("_a", "_ta"), items.toDF("_b", "_tb")
        left = rows.join(own, F.col(a) == F.col("_a"), "left").join(other, F.col(b) == F.col("_b"), "left").withColumn("_r", F.col(y) - F.coalesce("_ta", F.lit(0.0)) + F.coalesce("_tb", F.lit(0.0)))
        effects = stored(left.groupBy(entity).agg((F.sum("_r") / (F.count("_r") + K)).alias("effect")), "effects")
        mine, theirs = effects.toDF("_e", "_me"), effects.toDF("_o", "_oe")
        rest = rows.join(mine, F.col(entity) == F.col("_e"), "left").join(theirs, F.col(opp_entity) == F.col("_o"), "left")
        theta = fit_pair_ridge(rest.withColumn("_y", F.col(y) - F.coalesce("_me", F.lit(0.0)) + F.coalesce("_oe", F.lit(0.0))), a, b, "_y", lam)
    return theta, effects


def lr_cv(df: DataFrame, key: str, xs: list[str], y: str, folds: int = 5, seed="cv") -> DataFrame:
    """Out-of-fold accuracy, log-loss and AUC of a logistic regression; folds by a hash of the key.

    All folds are fitted side by side, a pass over the stored columns for each Newton round.  Without a penalty the
    probabilities do not depend on the columns' scales.
    """
    rows = stored(df.select(*xs, y, F.floor(hash_uniform(seed, key) * folds).cast("int").alias("fold")), "cv-rows")
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: k != F.col("fold"))
    theta = theta_table(df.sparkSession, logistic_fits(rows.withColumn("fits", others), "fits", folds, xs, y)).withColumnRenamed("fit", "fold")
    scored = rows.join(F.broadcast(theta), "fold").select(y, sigmoid(linear(F.col("theta"), xs)).alias("p"))
    return binary_metrics(scored, y, "p").crossJoin(auc(scored, "p", y))


def one_fit(rows: DataFrame, xs: list[str], y: str) -> np.ndarray | None:
    """Intercept and coefficients of one logistic model without a penalty; None without rows.  rows: stored, as each Newton round reads them."""
    return logistic_fits(rows.withColumn("fits", F.array(F.lit(0))), "fits", 1, xs, y).get(0)


def lr_coefficients(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, coefficient) on standardised columns: the coefficients of the plain ones times their deviations."""
    rows = stored(df.select(*[F.col(x).cast("double").alias(x) for x in xs], y).dropna(), "lr-rows")
    theta = one_fit(rows, xs, y)
    if theta is None:
        return df.sparkSession.createDataFrame([], "term string, coefficient double")
    at = rows.agg(*[F.avg(x).alias(f"m{k}") for k, x in enumerate(xs)], *[F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias(f"s{k}") for k, x in enumerate(xs)]).first()
    start = theta[0] + sum(theta[k + 1] * at[f"m{k}"] for k in range(len(xs)))
    return df.sparkSession.createDataFrame([("intercept", float(start)), *[(x, float(theta[k + 1] * at[f"s{k}"])) for k, x in enumerate(xs)]], "term string, coefficient double")


def lr_response(df: DataFrame, x: str, y: str, points: list[float]) -> DataFrame:
    """The modelled probability at chosen points."""
    theta = one_fit(stored(df.select(F.col(x).cast("double").alias(x), y), "lr-rows"), [x], y)
    grid = df.sparkSession.createDataFrame([(float(p),) for p in points], f"{x} double")
    return grid.select(x, (F.lit(None).cast("double") if theta is None else sigmoid(linear([float(t) for t in theta], [x]))).alias("p"))


def multinomial_ranks(df: DataFrame, train, tokens: str, label: str, C: float = 1.0) -> DataFrame:
    """(true, rank) of held-out rows under a multinomial model of token sets; train: the condition of training rows."""
    rows = stored(df.select(tokens, label, train.alias("_train")), "rank-rows")  # counted, indexed and fitted in several passes
    learn, held = rows.filter("_train"), rows.filter("not _train")
    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    count = CountVectorizer(inputCol=tokens, outputCol="features", binary=True, minDF=2)
    n = learn.count()
    model = Pipeline(stages=[index, count, LogisticRegression(labelCol="_y", family="multinomial", regParam=1 / (C * max(n, 1)), maxIter=30)]).fit(learn)
    out = model.transform(held).withColumn("_p", vector_to_array("probability"))
    own = F.element_at("_p", F.col("_y").cast("int") + 1)
    return out.select(F.col(label).alias("true"), (F.size(F.filter("_p", lambda x: x > own)) + 1).alias("rank"))


def single_auc(df: DataFrame, xs: list[str], y: str) -> DataFrame:
    """(term, auc): how well each column alone ranks the label."""
    return auc(df.select(y, *[F.col(x).cast("double").alias(x) for x in xs]).unpivot([y], xs, "term", "_x"), "_x", y, ["term"])


def identity_features(df: DataFrame, contest: str, item: str, side: str, own) -> tuple[DataFrame, list[str]]:
    """One row per contest with a column for each item (as many as the catalogue has): its count on the own side less the other."""
    from tallyard.functions.scalars import signed_features

    items = [r[0] for r in bounded(df.select(item).filter(F.col(item).isNotNull()).distinct().orderBy(item), MOST_ITEMS, "items")]
    wide = signed_features(df, contest, item, side, own).groupBy(contest).pivot(item, items).agg(F.sum("sign"))
    names = [f"x{k}" for k in range(len(items))]
    return wide.select(contest, *[F.coalesce(F.col(f"`{i}`").cast("double"), F.lit(0.0)).alias(n) for i, n in zip(items, names)]), names


def lr_select(df: DataFrame, train, valid, test, xs: list[str], y: str, grid: list[float]) -> DataFrame:
    """(reg, log_loss, accuracy) of each penalty on the validation rows; the best is fitted again on training and validation
    rows, and its row has the test rows' test_n, test_accuracy, test_log_loss and test_brier."""
    rows = VectorAssembler(inputCols=xs, outputCol="features").transform(df.withColumn("_part", F.when(train, 0).when(valid, 1).when(test, 2)))
    ready = stored(rows.filter("_part is not null").select("features", y, "_part"), "lr-rows")

    def scores(reg: float, fit: str, on: str) -> DataFrame:
        model = LogisticRegression(labelCol=y, regParam=reg).fit(ready.filter(fit))
        return binary_metrics(model.transform(ready.filter(on)).withColumn("_p", F.element_at(vector_to_array("probability"), 2)), y, "_p")

    tried = [(reg, *scores(reg, "_part = 0", "_part = 1").select("log_loss", "accuracy").first()) for reg in grid]
    best = min(tried, key=lambda t: (t[1] is None, t[1] or 0.0, t[0]))[0]
    found = scores(best, "_part < 2", "_part = 2").select("n", "accuracy", "log_loss", "brier").first()
    out = [(*map(float, t), t[0] == best, *(found if t[0] == best else (None,) * 4)) for t in tried]
    return df.sparkSession.createDataFrame(out, "reg double, log_loss double, accuracy double, best boolean, test_n long, test_accuracy double, test_log_loss double, test_brier double")


def nested_lr(df: DataFrame, train, models: dict[str, list[str]], y: str) -> DataFrame:
    """(model, held-out n, accuracy, log_loss, brier) of logistic models on nested column sets."""
    columns = list(dict.fromkeys(x for xs in models.values() for x in xs))
    rows = stored(df.select(*[F.col(x).cast("double").alias(x) for x in columns], y, F.coalesce(train, F.lit(False)).alias("_train"), F.coalesce(~train, F.lit(False)).alias("_held")), "lr-rows")
    out = None
    for name, xs in models.items():
        theta = one_fit(rows.filter("_train"), xs, y)
        p = F.lit(None).cast("double") if theta is None else sigmoid(linear([float(t) for t in theta], xs))
        m = binary_metrics(rows.filter("_held").withColumn("_p", p), y, "_p").withColumn("model", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


def weighted_ensemble(df: DataFrame, train, cols: list[str], y: str) -> DataFrame:
    """Adds ensemble: the columns weighted by their accuracy on training rows over 1/2 (not below 0)."""
    acc = [F.greatest(F.avg(F.when((F.col(c) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)) - 0.5, F.lit(0.0)).alias(f"_w{i}") for i, c in enumerate(cols)]
    w = df.filter(train).agg(*acc)
    total = sum((F.col(f"_w{i}") for i in range(len(cols))), F.lit(0.0))
    mix = sum((F.col(f"_w{i}") * F.col(c) for i, c in enumerate(cols)), F.lit(0.0))
    plain = sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)
    return df.crossJoin(F.broadcast(w)).withColumn("ensemble", F.when(total > 0, mix / total).otherwise(plain)).drop(*[f"_w{i}" for i in range(len(cols))])


def forward_test(df: DataFrame, event: str, time: str, cols: list[str], y: str, p_eps: float = 1e-6) -> DataFrame:
    """For each event, weights from all rows before its first date, then n, accuracy and log-loss on its rows.

    Accuracies up to each date are running sums over dates; each event looks up the last date before its first.
    """
    hits = [F.sum(F.when((F.col(c) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)).alias(f"_h{i}") for i, c in enumerate(cols)]
    daily = df.groupBy(F.col(time).alias("_d")).agg(F.count("*").alias("_n"), *hits)
    w = Window.orderBy("_d")
    run = daily.select("_d", F.sum("_n").over(w).alias("_n"), *[F.sum(f"_h{i}").over(w).alias(f"_h{i}") for i in range(len(cols))])
    starts = df.groupBy(event).agg(F.min(time).alias("_start"))
    state = starts.join(run, F.col("_d") < F.col("_start")).groupBy(event).agg(F.max_by(F.struct("_n", *[f"_h{i}" for i in range(len(cols))]), "_d").alias("_state"))
    ws = [F.greatest(F.col(f"_state._h{i}") / F.col("_state._n") - 0.5, F.lit(0.0)) for i in range(len(cols))]
    total = sum(ws, F.lit(0.0))
    rows = df.join(state, event)
    mix = F.when(total > 0, sum((wi * F.col(c) for wi, c in zip(ws, cols)), F.lit(0.0)) / total).otherwise(sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols))
    return binary_metrics(rows.withColumn("_e", mix), y, "_e", [event], p_eps)


def marginal_rank(train: DataFrame, test: DataFrame, role: str, period: str, item: str) -> DataFrame:
    """test with rank: of its item by count in (role, period) of train, else in the role, else null."""
    def ranked(keys, name):
        c = train.groupBy(*keys, item).agg(F.count("*").alias("_n"))
        return c.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_n"), item))).drop("_n")

    fine, coarse = ranked([role, period], "_fine"), ranked([role], "_coarse")
    known = fine.select(role, period).distinct().withColumn("_known", F.lit(True))
    j = test.join(known, [role, period], "left").join(fine, [role, period, item], "left").join(coarse, [role, item], "left")
    return j.withColumn("rank", F.when(F.coalesce("_known", F.lit(False)), F.col("_fine")).otherwise(F.col("_coarse"))).drop("_known", "_fine", "_coarse")


def segment_classifier(segments: DataFrame, train, features: list[str], label: str, key: str) -> DataFrame:
    """(key, label, voted): a forest on segments standardised on training rows alone, one vote per segment."""
    from .metrics import majority_vote

    index = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="skip")
    pipe = Pipeline(stages=[index, VectorAssembler(inputCols=features, outputCol="_f"), StandardScaler(inputCol="_f", outputCol="features", withMean=True), RandomForestClassifier(labelCol="_y", numTrees=20, seed=7)])
    out = pipe.fit(segments.filter(train)).transform(segments.filter(~train))
    votes = majority_vote(out.select(key, "prediction"), key, "prediction")
    return out.select(key, "_y").distinct().join(votes, key).select(key, F.col("_y").alias("label"), "voted")
