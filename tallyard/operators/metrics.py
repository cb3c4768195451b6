"""Metrics of predictions: probabilities, ranks, classes, regressions, votes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def binary_metrics(df: DataFrame, y: str, p: str, by: list[str] = (), eps: float = 1e-6) -> DataFrame:
    """n, accuracy, log-loss and Brier score with p clipped to [eps, 1 - eps]."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    loss = -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))
    hit = F.when((F.col(p) >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(loss).alias("log_loss"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))


def ece(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """Expected calibration error over equal bins, the last closed on the right."""
    cell = df.withColumn("_b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))).groupBy("_b").agg(F.count("*").alias("_n"), F.avg(p).alias("_p"), F.avg(y).alias("_y"))
    return cell.agg((F.sum(F.abs(F.col("_p") - F.col("_y")) * F.col("_n")) / F.sum("_n")).alias("ece"))


def reliability(df: DataFrame, y: str, p: str, edges: list[float]) -> DataFrame:
    """By confidence of the favourite: n, mean confidence, share of favourites that won."""
    from tallyard.functions.scalars import bin_by

    conf = F.greatest(F.col(p), 1 - F.col(p))
    won = F.when(F.col(p) >= 0.5, F.col(y)).otherwise(1 - F.col(y))
    rows = df.withColumn("confidence", conf).withColumn("won", won).withColumn("bin", bin_by("confidence", edges, list(range(len(edges) + 1))))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("won").alias("won"))


def auc(df: DataFrame, score: str, label: str, by: list[str] = (), ranges: int = 256) -> DataFrame:
    """Rank AUC, tied scores averaged; null if a class is empty; null scores rank lowest.

    Rows collapse to distinct scores.  These stand in ranges between approximate quantiles of the distinct scores, so the running
    sums of a group (or of the whole table) spread over tasks; the few totals by range put them together.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    cell = rows.groupBy(*keys, score).agg(F.sum(F.col(label).cast("double")).alias("_p"), F.sum(1 - F.col(label).cast("double")).alias("_q"))
    edges = cell.agg(F.percentile_approx(score, [k / ranges for k in range(1, ranges)]).alias("_e"))
    placed = cell.crossJoin(F.broadcast(edges)).withColumn("_b", F.coalesce(F.size(F.filter("_e", lambda e: e < F.col(score))), F.lit(0)))
    below = F.sum("_q").over(Window.partitionBy(*keys, "_b").orderBy(score)) - F.col("_q") / 2
    part = placed.withColumn("_w", F.col("_p") * below).groupBy(*keys, "_b").agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    before = F.sum("_q").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_q")
    out = part.withColumn("_w", F.col("_w") + F.col("_p") * before).groupBy(*keys).agg(F.sum("_w").alias("_w"), F.sum("_p").alias("_P"), F.sum("_q").alias("_Q"))
    return out.select(*by, F.try_divide("_w", F.col("_P") * F.col("_Q")).alias("auc"))


def regression_metrics(df: DataFrame, y: str, yhat: str, by: list[str] = ()) -> DataFrame:
    """R2 against the evaluation set's own mean (null when it does not vary), MAE and the mean's MAE."""
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(1))
    mean = rows.groupBy(*keys).agg(F.avg(y).alias("_m"))
    joined = rows.join(mean, keys)
    e, d = F.col(y) - F.col(yhat), F.col(y) - F.col("_m")
    return joined.groupBy(*keys).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.sum(d * d))).alias("r2"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(d)).alias("mae_mean")).select(*by, "n", "r2", "mae", "mae_mean")


def hit_at_k(df: DataFrame, rank: str, ks: list[int], by: list[str] = ()) -> DataFrame:
    """Share of rows whose true item ranks within k; a null rank misses."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(F.when(F.col(rank) <= k, 1.0).otherwise(0.0)).alias(f"hit{k}") for k in ks])


def class_report(df: DataFrame, y: str, pred: str) -> tuple[DataFrame, DataFrame]:
    """Confusion counts, and accuracy per class."""
    return df.groupBy(y, pred).agg(F.count("*").alias("n")), df.groupBy(y).agg(F.count("*").alias("n"), F.avg((F.col(y) == F.col(pred)).cast("double")).alias("accuracy"))


def majority_vote(df: DataFrame, key: str, cls: str) -> DataFrame:
    """The most frequent class per key, the lowest on ties."""
    counts = df.groupBy(key, cls).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), cls))).filter("_r = 1").select(key, F.col(cls).alias("voted"), "n")


def soft_vote(df: DataFrame, key: str, model: str, cls: str, p: str) -> DataFrame:
    """Mean probability over segments, then over models; the best class, the lowest on ties."""
    per_model = df.groupBy(key, model, cls).agg(F.avg(p).alias("_p"))
    mean = per_model.groupBy(key, cls).agg(F.avg("_p").alias("_p"))
    best = mean.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("_p", 9)), cls)))
    return best.filter("_r = 1").select(key, F.col(cls).alias("voted"), F.col("_p").alias("mean_p"))


def beta_interval(df: DataFrame, wins: str, n: str, level: float = 0.95, points: int = 4000) -> DataFrame:
    """Adds low and high: the equal-tailed interval of Beta(wins + 1/2, n - wins + 1/2).

    The CDF by the midpoint rule in the angle (x = sin^2), where the deviation is near 1 / (2 sqrt(n)) for any rate, on points
    over ten deviations around the mean; both ends come from one pass over blocks of rows.
    """
    ends = ((1 - level) / 2, (1 + level) / 2)

    @F.pandas_udf("low double, high double")
    def bounds(w: pd.Series, m: pd.Series) -> pd.DataFrame:
        out = np.full((len(w), 2), np.nan)
        valid = np.flatnonzero((w.notna() & m.notna()).to_numpy())
        for at in range(0, len(valid), 256):
            rows = valid[at : at + 256]
            a, b = w.to_numpy()[rows, None] + 0.5, (m - w).to_numpy()[rows, None] + 0.5
            centre, reach = np.arcsin(np.sqrt(a / (a + b))), 5 / np.sqrt(a + b)
            first, last = np.maximum(centre - reach, 0), np.minimum(centre + reach, np.pi / 2)
            step = (last - first) / points
            t = first + (np.arange(points) + 0.5) * step
            log = (2 * a - 1) * np.log(np.sin(t)) + (2 * b - 1) * np.log(np.cos(t))
            c = np.cumsum(np.exp(log - log.max(1, keepdims=True)), axis=1)
            edge = np.pad(c / c[:, -1:], ((0, 0), (1, 0)))
            each = np.arange(len(rows))
            for side, q in enumerate(ends):
                k = (edge[:, 1:] < q).sum(1)
                part = (q - edge[each, k]) / (edge[each, k + 1] - edge[each, k])
                out[rows, side] = np.sin(first[:, 0] + (k + part) * step[:, 0]) ** 2
        return pd.DataFrame(out, columns=["low", "high"])

    return df.withColumn("_i", bounds(F.col(wins).cast("double"), F.col(n).cast("double"))).select(*df.columns, "_i.low", "_i.high")


def method_table(df: DataFrame, group: str, method: str, score: str) -> DataFrame:
    """Mean score per group and method; the row with a null group is the overall mean of its method."""
    return df.rollup(method, group).agg(F.count("*").alias("n"), F.avg(score).alias("score")).filter(F.col(method).isNotNull())


def best_method(df: DataFrame, group: str, method: str, score: str) -> DataFrame:
    """Per group: best method (the first by name on ties), its score, and the spread over methods."""
    m = df.groupBy(group, method).agg(F.avg(score).alias("s"))
    w = Window.partitionBy(group)
    r = m.withColumn("_r", F.row_number().over(w.orderBy(F.desc(F.round("s", 9)), method))).withColumn("spread", F.max("s").over(w) - F.min("s").over(w))
    return r.filter("_r = 1").select(group, F.col(method).alias("best"), F.col("s").alias("score"), "spread")


def group_extremes(df: DataFrame, group: str, method: str, score: str) -> DataFrame:
    """Per method: its best and its worst group by mean score, both means and the spread; of groups with one mean the last by
    name is the best and the first the worst.  Rows without a group, a method or a score are left out."""
    rows = df.filter(F.col(group).isNotNull() & F.col(method).isNotNull() & F.col(score).isNotNull())
    m = rows.groupBy(method, group).agg(F.avg(score).alias("_s")).withColumn("_m", F.struct(F.round("_s", 9), F.col(group).alias("g"), F.col("_s").alias("s")))
    ends = m.groupBy(method).agg(F.max("_m").alias("_b"), F.min("_m").alias("_w"))
    return ends.select(method, F.col("_b.g").alias("best"), F.col("_b.s").alias("best_score"), F.col("_w.g").alias("worst"), F.col("_w.s").alias("worst_score"), (F.col("_b.s") - F.col("_w.s")).alias("spread"))


def best_row(df: DataFrame, order: str, value: str) -> DataFrame:
    """One row: where the value is highest (the first such), and the value."""
    return df.agg(F.max(F.struct(F.col(value), -F.col(order))).alias("b")).select((-F.col(f"b.col2")).cast("int").alias(order), F.col(f"b.{value}").alias(value))


def coverage(train: DataFrame, test: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """Share of test rows whose key has at least k training rows."""
    n = train.groupBy(key).agg(F.count("*").alias("_n"))
    return test.join(n, key, "left").agg(F.count("*").alias("n"), *[F.avg(F.when(F.col("_n") >= k, 1.0).otherwise(0.0)).alias(f"cover{k}") for k in ks])
