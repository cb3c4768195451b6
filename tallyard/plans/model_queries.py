"""Learned and iterative estimators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import fits
from tallyard.operators import metrics as mt
from tallyard.operators import models as m
from tallyard.operators import stats as s
from tallyard.operators.boosting import Boosting, boost_sweep
from tallyard.sources.readers import stored

from .panel import PANEL, pairs, panel, picks
from .registry import query


def r(c, n=6):
    return F.round(c, n).alias(c)


@query("E5_pair_ridge")
def pair_ridge(spark, d):
    return m.pair_ridge(pairs(spark, d), "item", "opp_item", "diff", 25.0, "role").select("role", "item", r("theta", 4))


@query("E6_backfit")
def backfit(spark, d):
    return m.backfit(pairs(spark, d), "item", "opp_item", "entity", "opp_entity", "diff", 25.0, 20.0)[1].select("entity", r("effect", 4))


LADDER = PANEL + """, tr AS (SELECT * FROM panel WHERE period < 1997), te AS (SELECT * FROM panel WHERE period >= 1997), m0 AS (SELECT avg(y) AS m0 FROM tr), m1 AS (SELECT item, avg(y) AS m1 FROM tr GROUP BY 1), m2 AS (SELECT entity, sum(y - m1) / (count(*) + 20) AS e FROM tr JOIN m1 USING (item) GROUP BY 1),
 pr AS (SELECT y, m0, coalesce(m1, m0) AS m1, coalesce(m1, m0) + coalesce(e, 0) AS m2 FROM te CROSS JOIN m0 LEFT JOIN m1 USING (item) LEFT JOIN m2 USING (entity)), lo AS (UNPIVOT pr ON m0, m1, m2 INTO NAME model VALUE yhat), x AS (SELECT *, avg(y) OVER () AS m FROM lo)"""


@query("E7_accuracy_ladder", f"WITH {LADDER} SELECT model, count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / sum((y - m) * (y - m)), 6) AS r2, round(avg(abs(y - yhat)), 4) AS mae FROM x GROUP BY 1")
def accuracy_ladder(spark, d):
    p = panel(spark, d)
    train, test = p.filter("period < 1997"), p.filter("period >= 1997")
    m0, m1 = train.agg(F.avg("y").alias("m0")), train.groupBy("item").agg(F.avg("y").alias("m1"))
    own = s.shrunk_mean(train.join(m1, "item").withColumn("_r", F.col("y") - F.col("m1")), "entity", "_r", 20)
    pr = test.crossJoin(F.broadcast(m0)).join(m1, "item", "left").join(own, "entity", "left").withColumn("m1", F.coalesce("m1", "m0")).withColumn("m2", F.col("m1") + F.coalesce("shrunk", F.lit(0.0)))
    long = pr.select("y", "m0", "m1", "m2").unpivot(["y"], ["m0", "m1", "m2"], "model", "yhat")
    return mt.regression_metrics(long, "y", "yhat", ["model"]).select("model", "n", r("r2"), r("mae", 4))


#: Four settings from supple to stiff: learning rate, leaves, rows of a leaf, penalty.
TREES = [Boosting("supple", 0.05, 63, 50, 1.0), Boosting("stiff", 0.03, 15, 300, 10.0), Boosting("very stiff", 0.02, 7, 1000, 30.0), Boosting("heavy penalty", 0.05, 7, 500, 100.0)]


@query("E8_gbt_sweep")
def gbt_sweep(spark, d):
    """Up to 600 trees a setting, stopped after 25 without a gain on a tenth of the training contests."""
    p = stored(pairs(spark, d).select("contest", "entity", "opp_entity", "item", "opp_item", "role", "period", "diff"), "boost-pairs")  # skill and rows both read it
    skill = p.filter("period < 1997").groupBy("entity").agg((F.sum("diff") / (F.count("*") + 20)).alias("skill"))
    theirs = skill.select(F.col("entity").alias("opp_entity"), F.col("skill").alias("opp_skill"))
    rows = p.join(skill, "entity", "left").join(theirs, "opp_entity", "left").fillna(0.0, ["skill", "opp_skill"])
    return boost_sweep(rows, F.col("period") < 1997, "contest", ["item", "opp_item", "role", "period"], ["skill", "opp_skill"], "diff", TREES).select("setting", "trees", "n", r("r2"), r("mae", 3), r("auc"))


def numeric(spark, d):
    return s.familiarity(panel(spark, d), "entity", "item").withColumn("size", F.col("y") / 1e4).select("contest", "entity", "period", "t", "p", "familiarity", "size", "win")


@query("E9_lr_cv")
def lr_cv(spark, d):
    return m.lr_cv(numeric(spark, d), "contest", ["p", "familiarity", "size"], "win", 5).select("n", r("accuracy"), r("log_loss"), r("auc"))


@query("E9_lr_coefficients")
def lr_coefficients(spark, d):
    return m.lr_coefficients(numeric(spark, d), ["p", "familiarity", "size"], "win").select("term", r("coefficient", 4))


FAMILIAR = PANEL + ", cc AS (SELECT entity, item, count(*) AS n FROM panel GROUP BY 1, 2), fm AS (SELECT entity, item, n / sum(n) OVER (PARTITION BY entity) AS familiarity FROM cc), nu AS (SELECT p, familiarity, y / 10000 AS size, win FROM panel JOIN fm USING (entity, item))"


@query("E9_single_auc", f"""WITH {FAMILIAR}, lo AS (UNPIVOT nu ON p, familiarity, size INTO NAME term VALUE v), g AS (SELECT term, v, sum(win) AS a, sum(1 - win) AS b FROM lo GROUP BY 1, 2), x AS (SELECT *, sum(b) OVER (PARTITION BY term ORDER BY v) - b / 2.0 AS below FROM g)
 SELECT term, round(sum(a * below) / (sum(a) * sum(b)), 5) AS auc FROM x GROUP BY 1""")
def single_auc(spark, d):
    return m.single_auc(numeric(spark, d), ["p", "familiarity", "size"], "win").select("term", r("auc", 5))


@query("E10_lr_response")
def lr_response(spark, d):
    return m.lr_response(numeric(spark, d), "size", "win", [1.0, 5.0, 9.0]).select("size", r("p", 4))


@query("E11_multinomial_ranks")
def multinomial_ranks(spark, d):
    p = picks(panel(spark, d))
    from tallyard.functions.scalars import context_features

    tokens = context_features(p, "contest", "side", "role", "item", "slot").groupBy("contest", "slot").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    own = F.concat(F.lit("role:"), F.col("role"))
    rows = p.join(tokens, ["contest", "slot"], "left").select("period", "item", F.concat(F.coalesce("tokens", F.array().cast("array<string>")), F.array(own)).alias("tokens"))
    return mt.hit_at_k(m.multinomial_ranks(rows, F.col("period") < 1997, "tokens", "item"), "rank", [1, 3]).select("n", r("hit1"), r("hit3"))


@query("E12_lr_select")
def lr_select(spark, d):
    p = panel(spark, d)
    wide, names = m.identity_features(p, "contest", "item", "side", "F")
    won = p.groupBy("contest").agg(F.min("period").alias("period"), (F.sum(F.when(F.col("side") == "F", F.col("y")).otherwise(-F.col("y"))) > 0).cast("int").alias("won"))
    at = F.col("period")
    found = m.lr_select(wide.join(won, "contest"), at < 1996, at == 1996, at > 1996, names, "won", [0.001, 0.01, 0.1])
    return found.select("reg", r("log_loss"), r("accuracy"), "best", "test_n", r("test_accuracy"), r("test_log_loss"), r("test_brier"))


@query("E13_nested_lr")
def nested_lr(spark, d):
    rows = numeric(spark, d).withColumn("both", F.col("p") * F.col("size"))
    return m.nested_lr(rows, F.col("period") < 1997, {"base": ["p"], "main": ["p", "size"], "interaction": ["p", "size", "both"]}, "win").select("model", "n", r("accuracy"), r("log_loss"), r("brier"))


PROBS = PANEL + ", z AS (SELECT *, 1 - p AS q, least(y / 100000, 0.99::DOUBLE) AS s FROM panel)"


def probabilities(spark, d):
    return panel(spark, d).withColumn("q", 1 - F.col("p")).withColumn("s", F.least(F.col("y") / 100000, F.lit(0.99)))


def acc(c: str) -> str:
    return f"greatest(avg(CASE WHEN ({c} >= 0.5) = (win = 1) THEN 1.0::DOUBLE ELSE 0.0 END) - 0.5, 0)"


@query("E14_weighted_ensemble", f"""WITH {PROBS}, w AS (SELECT {acc('p')} AS wp, {acc('q')} AS wq, {acc('s')} AS ws FROM z WHERE period < 1997),
 e AS (SELECT win, CASE WHEN wp + wq + ws > 0 THEN (wp * p + wq * q + ws * s) / (wp + wq + ws) ELSE (p + q + s) / 3 END AS e FROM z, w WHERE period >= 1997)
 SELECT count(*) AS n, round(avg(CASE WHEN (e >= 0.5) = (win = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((e - win) * (e - win)), 6) AS brier FROM e""")
def weighted_ensemble(spark, d):
    e = m.weighted_ensemble(probabilities(spark, d), F.col("period") < 1997, ["p", "q", "s"], "win").filter("period >= 1997")
    return mt.binary_metrics(e, "win", "ensemble").select("n", r("accuracy"), r("brier"))


@query("E15_forward_test", f"""WITH {PROBS}, ev AS (SELECT period, min(t) AS start FROM z GROUP BY 1), w AS (SELECT ev.period, {acc('p')} AS wp, {acc('q')} AS wq, {acc('s')} AS ws FROM ev JOIN z ON z.t < ev.start GROUP BY 1),
 e AS (SELECT period, win, CASE WHEN wp + wq + ws > 0 THEN (wp * p + wq * q + ws * s) / (wp + wq + ws) ELSE (p + q + s) / 3 END AS e FROM z JOIN w USING (period))
 SELECT period, count(*) AS n, round(avg(CASE WHEN (e >= 0.5) = (win = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((e - win) * (e - win)), 6) AS brier FROM e GROUP BY 1""")
def forward_test(spark, d):
    return m.forward_test(probabilities(spark, d), "period", "t", ["p", "q", "s"], "win").select("period", "n", r("accuracy"), r("brier"))


@query("E15_forward_fits")
def forward_fits(spark, d):
    """A logistic model for each year's past, its ensemble with the given probabilities, and a 90% interval over contests."""
    rows = probabilities(spark, d).withColumn("size", F.col("y") / 1e4).withColumn("age", F.col("ln") / 7.0)
    scores, coefficients = fits.forward_fits(rows, "period", "t", "contest", ["p", "q", "s"], ["size", "age"], "win")
    b = coefficients.select("period", *[F.round(F.col("theta")[k], 5).alias(f"b{k}") for k in range(3)])
    return scores.join(b, "period").select("period", "n", "n_contests", "n_train", r("accuracy"), r("fitted_accuracy"), r("log_loss"), r("brier"), r("low"), r("high"), "inside", "b0", "b1", "b2")


@query("E16_marginal_rank", f"""WITH {PANEL}, tr AS (SELECT * FROM panel WHERE period <= 1996), fi AS (SELECT role, weekofyear(t) AS m, item, row_number() OVER (PARTITION BY role, weekofyear(t) ORDER BY count(*) DESC, item) AS k FROM tr GROUP BY 1, 2, 3), co AS (SELECT role, item, row_number() OVER (PARTITION BY role ORDER BY count(*) DESC, item) AS k FROM tr GROUP BY 1, 2), kn AS (SELECT DISTINCT role, m FROM fi),
 x AS (SELECT p.*, CASE WHEN kn.m IS NOT NULL THEN fi.k ELSE co.k END AS rank FROM panel p LEFT JOIN kn ON kn.role = p.role AND kn.m = weekofyear(p.t) LEFT JOIN fi ON fi.role = p.role AND fi.m = weekofyear(p.t) AND fi.item = p.item LEFT JOIN co ON co.role = p.role AND co.item = p.item WHERE period > 1996)
 SELECT role, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5 FROM x GROUP BY 1""")
def marginal_rank(spark, d):
    p = panel(spark, d).withColumn("week", F.weekofyear("t"))
    ranked = m.marginal_rank(p.filter("period <= 1996"), p.filter("period > 1996"), "role", "week", "item")
    return mt.hit_at_k(ranked, "rank", [1, 5], ["role"]).select("role", "n", r("hit1"), r("hit5"))


@query("E22_segment_classifier")
def segment_classifier(spark, d):
    from .panel import table

    v = table(spark, d, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).withColumn("segment", F.floor(F.col("i") / 16))
    seg = v.groupBy("vec_id", "label", "segment").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.max("x").alias("most"))
    out = m.segment_classifier(seg.withColumn("label", F.col("label").cast("string")), F.col("vec_id") % 5 != 0, ["mean", "std", "most"], "label", "vec_id")
    return out
