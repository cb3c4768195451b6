"""Metrics of predictions, votes and method tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyard.operators import metrics as m

from .panel import PANEL, panel, table
from .registry import query


def r(c, n=6):
    return F.round(c, n).alias(c)


@query("A19_binary_metrics", f"WITH {PANEL}, q AS (SELECT *, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS c FROM panel) SELECT role, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (win = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-(win * ln(c) + (1 - win) * ln(1 - c))), 6) AS log_loss, round(avg((p - win) * (p - win)), 6) AS brier FROM q GROUP BY 1")
def binary_metrics(spark, d):
    return m.binary_metrics(panel(spark, d), "win", "p", ["role"]).select("role", "n", r("accuracy"), r("log_loss"), r("brier"))


@query("A20_ece", f"WITH {PANEL}, b AS (SELECT least(floor(p * 10), 9) AS b, count(*) AS n, avg(p) AS p, avg(win) AS w FROM panel GROUP BY 1) SELECT round(sum(abs(p - w) * n) / sum(n), 6) AS ece FROM b")
def ece(spark, d):
    return m.ece(panel(spark, d), "win", "p").select(r("ece"))


@query("A21_reliability", f"""WITH {PANEL}, q AS (SELECT greatest(p, 1 - p) AS c, CASE WHEN p >= 0.5 THEN win ELSE 1 - win END AS w FROM panel)
 SELECT CASE WHEN c < 0.55 THEN 0 WHEN c < 0.65 THEN 1 WHEN c < 0.75 THEN 2 WHEN c < 0.85 THEN 3 ELSE 4 END AS bin, count(*) AS n, round(avg(c), 6) AS confidence, round(avg(w), 6) AS won FROM q GROUP BY 1""")
def reliability(spark, d):
    return m.reliability(panel(spark, d), "win", "p", [0.55, 0.65, 0.75, 0.85]).select("bin", "n", r("confidence"), r("won"))


@query("A22_auc", f"""WITH {PANEL}, g AS (SELECT role, p, sum(win) AS a, sum(1 - win) AS b FROM panel GROUP BY 1, 2), c AS (SELECT *, sum(b) OVER (PARTITION BY role ORDER BY p) - b AS below FROM g)
 SELECT role, round(sum(a * (below + b / 2.0)) / (sum(a) * sum(b)), 9) AS auc FROM c GROUP BY 1""")
def auc(spark, d):
    return m.auc(panel(spark, d), "p", "win", ["role"]).select("role", r("auc", 9))


@query("A23_regression_metrics", f"WITH {PANEL}, b AS (SELECT item, avg(y) AS yhat FROM panel GROUP BY 1), x AS (SELECT role, y, yhat, avg(y) OVER (PARTITION BY role) AS m FROM panel JOIN b USING (item)) SELECT role, count(*) AS n, round(1 - sum((y - yhat) * (y - yhat)) / sum((y - m) * (y - m)), 6) AS r2, round(avg(abs(y - yhat)), 4) AS mae, round(avg(abs(y - m)), 4) AS mae_mean FROM x GROUP BY 1")
def regression_metrics(spark, d):
    p = panel(spark, d)
    x = p.join(p.groupBy("item").agg(F.avg("y").alias("yhat")), "item")
    return m.regression_metrics(x, "y", "yhat", ["role"]).select("role", "n", r("r2"), r("mae", 4), r("mae_mean", 4))


@query("A24_beta_interval")
def beta_interval(spark, d):
    g = panel(spark, d).groupBy("item").agg(F.sum("win").alias("wins"), F.count("*").alias("n"))
    return m.beta_interval(g, "wins", "n").select("item", "wins", "n", r("low"), r("high"))


RANKS = PANEL + """, c AS (SELECT role, item, count(*) AS n FROM panel WHERE period < 1997 GROUP BY 1, 2), k AS (SELECT role, item, row_number() OVER (PARTITION BY role ORDER BY n DESC, item) AS rank FROM c)"""


@query("A31_hit_at_k", f"WITH {RANKS} SELECT role, count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit5 FROM panel LEFT JOIN k USING (role, item) WHERE period >= 1997 GROUP BY 1")
def hit_at_k(spark, d):
    p = panel(spark, d)
    c = p.filter("period < 1997").groupBy("role", "item").agg(F.count("*").alias("n"))
    k = c.withColumn("rank", F.row_number().over(Window.partitionBy("role").orderBy(F.desc("n"), "item"))).drop("n")
    return m.hit_at_k(p.filter("period >= 1997").join(k, ["role", "item"], "left"), "rank", [1, 5], ["role"]).select("role", "n", r("hit1"), r("hit5"))


GUESS = "g AS (SELECT d.doc_id, quality, CASE WHEN n_chars > (SELECT median(n_chars) FROM documents) THEN 1 ELSE 0 END AS guess, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def guesses(spark, d):
    docs = table(spark, d, "documents")
    med = docs.agg(F.percentile("n_chars", F.lit(0.5)).alias("med"))
    return docs.join(table(spark, d, "labels"), "doc_id").crossJoin(F.broadcast(med)).select("doc_id", "quality", (F.col("n_chars") > F.col("med")).cast("int").alias("guess"), "lang")


@query("A32_confusion", f"WITH {GUESS} SELECT quality, guess, count(*) AS n FROM g GROUP BY 1, 2")
def confusion(spark, d):
    return m.class_report(guesses(spark, d), "quality", "guess")[0]


@query("A32_class_accuracy", f"WITH {GUESS} SELECT quality, count(*) AS n, round(avg(CASE WHEN quality = guess THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM g GROUP BY 1")
def class_accuracy(spark, d):
    return m.class_report(guesses(spark, d), "quality", "guess")[1].select("quality", "n", r("accuracy"))


@query("A33_majority_vote", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) SELECT user_id, event_type AS voted, n FROM k WHERE r = 1")
def majority_vote(spark, d):
    return m.majority_vote(table(spark, d, "events"), "user_id", "event_type")


@query("A34_soft_vote", """WITH a AS (SELECT user_id, event_id % 3 AS model, event_type, avg(value) AS p FROM events GROUP BY 1, 2, 3), b AS (SELECT user_id, event_type, avg(p) AS p FROM a GROUP BY 1, 2),
 k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, event_type) AS r FROM b) SELECT user_id, event_type AS voted, round(p, 6) AS mean_p FROM k WHERE r = 1""")
def soft_vote(spark, d):
    e = table(spark, d, "events").withColumn("model", F.col("event_id") % 3)
    return m.soft_vote(e, "user_id", "model", "event_type", "value").select("user_id", "voted", r("mean_p"))


@query("A39_method_table", "SELECT event_type AS method, CAST(user_id % 10 AS BIGINT) AS genre, count(*) AS n, round(avg(value), 6) AS score FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type))")
def method_table(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 10).alias("genre"), "value")
    return m.method_table(e, "genre", "method", "value").select("method", "genre", "n", r("score"))


@query("A39_best_method", """WITH a AS (SELECT user_id % 10 AS genre, event_type, avg(value) AS s FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY round(s, 9) DESC, event_type) AS r, max(s) OVER (PARTITION BY genre) - min(s) OVER (PARTITION BY genre) AS spread FROM a)
 SELECT genre, event_type AS best, round(s, 6) AS score, round(spread, 6) AS spread FROM k WHERE r = 1""")
def best_method(spark, d):
    e = table(spark, d, "events").withColumn("genre", F.col("user_id") % 10)
    return m.best_method(e, "genre", "event_type", "value").select("genre", "best", r("score"), r("spread"))


@query("A39_group_extremes", """WITH a AS (SELECT user_id % 10 AS genre, event_type, avg(value) AS s FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(s, 9) DESC, genre DESC) AS hi, row_number() OVER (PARTITION BY event_type ORDER BY round(s, 9), genre) AS lo FROM a)
 SELECT b.event_type AS method, b.genre AS best, round(b.s, 6) AS best_score, w.genre AS worst, round(w.s, 6) AS worst_score, round(b.s - w.s, 6) AS spread FROM k b JOIN k w ON w.event_type = b.event_type AND b.hi = 1 AND w.lo = 1""")
def group_extremes(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("method"), (F.col("user_id") % 10).alias("genre"), "value")
    return m.group_extremes(e, "genre", "method", "value").select("method", "best", r("best_score"), "worst", r("worst_score"), r("spread"))


@query("A40_best_epoch", "SELECT epoch, val FROM (SELECT CAST(user_id AS INT) AS epoch, round(avg(value), 4) AS val FROM events GROUP BY 1) ORDER BY val DESC, epoch LIMIT 1")
def best_epoch(spark, d):
    log = table(spark, d, "events").groupBy(F.col("user_id").cast("int").alias("epoch")).agg(F.round(F.avg("value"), 4).alias("val"))
    return m.best_row(log, "epoch", "val")
