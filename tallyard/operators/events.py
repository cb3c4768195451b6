"""Event sequences: votes on event times, matching, scores, parameter sweeps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairing import near_pairs


def median_run(df: DataFrame, key: str, run: str) -> DataFrame:
    """Per key the run with the median number of events: row floor(n / 2) + 1 by (count, run)."""
    counts = df.groupBy(key, run).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key)
    ranked = counts.withColumn("_r", F.row_number().over(w.orderBy("n", run))).withColumn("_m", F.count("*").over(w))
    return ranked.filter(F.col("_r") == F.floor(F.col("_m") / 2) + 1).select(key, run, "n")


def event_vote(reference: DataFrame, others: DataFrame, key: str, at: str, source: str, d: float, m: int) -> DataFrame:
    """Reference events that at least m sources confirm, the reference itself included."""
    pairs = near_pairs(reference, others, key, at, d, [source])
    votes = pairs.groupBy(key, at).agg(F.countDistinct(f"other_{source}").alias("n"))
    return votes.filter(F.col("n") + 1 >= m).withColumn("votes", F.col("n") + 1).drop("n")


def candidate_matches(pred: DataFrame, truth: DataFrame, key: str, at: str, d: float) -> DataFrame:
    """Per key: pairs of a predicted and a true event within d."""
    return near_pairs(pred, truth, key, at, d).groupBy(key).agg(F.count("*").alias("n_pairs"))


def event_prf(pred: DataFrame, truth: DataFrame, key: str, at: str, d: float) -> DataFrame:
    """Per key: n_pred, n_true, hits of a largest one-to-one matching within d, precision, recall, F.

    On a line the greedy matching of the earliest free pair is a largest one.
    """
    rows = pred.select(key, F.col(at).cast("double").alias("_t"), F.lit(0).alias("_k")).unionByName(truth.select(key, F.col(at).cast("double").alias("_t"), F.lit(1).alias("_k")))
    kind = dict(pred.dtypes)[key]

    def match(table: pa.Table) -> pa.Table:
        times, kinds = table["_t"].to_pylist(), table["_k"].to_pylist()
        p, q = sorted(t for t, k in zip(times, kinds) if k == 0), sorted(t for t, k in zip(times, kinds) if k == 1)
        i = j = hits = 0
        while i < len(p) and j < len(q):
            if abs(p[i] - q[j]) <= d:
                hits, i, j = hits + 1, i + 1, j + 1
            elif p[i] < q[j]:
                i += 1
            else:
                j += 1
        return pa.table({key: table[key][:1], "n_pred": pa.array([len(p)], pa.int64()), "n_true": pa.array([len(q)], pa.int64()), "hits": pa.array([hits], pa.int64())})

    out = rows.groupBy(key).applyInArrow(match, f"{key} {kind}, n_pred long, n_true long, hits long")
    out = out.withColumn("precision", F.coalesce(F.try_divide("hits", "n_pred"), F.lit(0.0))).withColumn("recall", F.coalesce(F.try_divide("hits", "n_true"), F.lit(0.0)))
    return out.withColumn("f", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def nearest_gap(truth: DataFrame, pred: DataFrame, key: str, at: str) -> DataFrame:
    """truth with gap: the distance to the nearest predicted event of its key (null without one); one window, no join."""
    rows = truth.select(key, F.col(at).alias("_t"), F.lit(1).alias("_k")).unionByName(pred.select(key, F.col(at).alias("_t"), F.lit(0).alias("_k")))
    w = Window.partitionBy(key).orderBy("_t", "_k")
    seen = F.when(F.col("_k") == 0, F.col("_t"))
    before = F.last(seen, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(seen, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("gap", F.least(F.col("_t") - before, after - F.col("_t")))
    return rows.filter("_k = 1").select(key, F.col("_t").alias(at), "gap")


def cemgil(truth: DataFrame, pred: DataFrame, key: str, at: str, sigma: float = 0.04) -> DataFrame:
    """Sum over true events of exp(-gap^2 / 2 sigma^2), over the mean of both counts."""
    near = nearest_gap(truth, pred, key, at).groupBy(key).agg(F.sum(F.coalesce(F.exp(-F.col("gap") * F.col("gap") / (2 * sigma * sigma)), F.lit(0.0))).alias("_s"), F.count("*").alias("n_true"))
    counts = pred.groupBy(key).agg(F.count("*").alias("n_pred"))
    out = near.join(counts, key, "left").withColumn("n_pred", F.coalesce("n_pred", F.lit(0)))
    return out.select(key, "n_true", "n_pred", (F.col("_s") / ((F.col("n_true") + F.col("n_pred")) / 2)).alias("cemgil"))


def p_score(truth: DataFrame, pred: DataFrame, key: str, at: str) -> DataFrame:
    """Pairs within 20% of the key's median true interval, over the larger count.

    That distance (a little more, against rounding) is the width of the key's own buckets in the range join.
    """
    step = truth.withColumn("_d", F.col(at) - F.lag(at).over(Window.partitionBy(key).orderBy(at)))
    reach = step.groupBy(key).agg((0.2 * F.percentile("_d", F.lit(0.5))).alias("reach"), F.count("*").alias("n_true"))
    wide = reach.filter("reach is not null").select(key, "reach", F.when(F.col("reach") > 0, F.col("reach") * 1.001).otherwise(1.0).alias("_w"))
    bucket = F.floor(F.col(at) / F.col("_w"))
    left = truth.select(key, at).join(wide, key).withColumn("_b", bucket)
    right = pred.select(key, at).join(wide.drop("reach"), key).withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1))).select(key, "_b", F.col(at).alias("_other"))
    hits = left.join(right, [key, "_b"]).filter(F.abs(F.col(at) - F.col("_other")) <= F.col("reach")).groupBy(key).agg(F.count("*").alias("hits"))
    n = pred.groupBy(key).agg(F.count("*").alias("n_pred"))
    out = reach.join(n, key, "left").join(hits, key, "left")
    return out.select(key, "n_true", F.coalesce("n_pred", F.lit(0)).alias("n_pred"), (F.coalesce("hits", F.lit(0)) / F.greatest("n_true", F.coalesce("n_pred", F.lit(0)))).alias("p_score"))


def sweep(df: DataFrame, params: str, order: str, score: str, group: str | None = None, last: bool = False) -> DataFrame:
    """The setting with the best mean score, per group or overall; ties go to the first (or last) setting."""
    keys = [group] if group else []
    mean = df.groupBy(*keys, params, order).agg(F.avg(score).alias("_s"))
    tie = F.desc(order) if last else F.asc(order)
    if not group:
        return mean.orderBy(F.desc(F.round("_s", 9)), tie).limit(1).select(params, F.col("_s").alias("score"))
    r = mean.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round("_s", 9)), tie)))
    return r.filter("_r = 1").select(group, params, F.col("_s").alias("score"))


def tuning_gain(df: DataFrame, params: str, order: str, score: str, group: str) -> DataFrame:
    """Per group, and overall with a null group: mean score of its own best setting, of the global best, and the gain."""
    own = sweep(df, params, order, score, group).select(F.col(group).alias("_g"), F.col(params).alias("_p"))
    best = sweep(df, params, order, score).select(F.col(params).alias("_q"))
    tuned = df.join(own, (df[group] == own["_g"]) & (df[params] == own["_p"])).select(group, F.col(score).alias("tuned"), F.lit(None).cast("double").alias("fixed"))
    fixed = df.join(F.broadcast(best), df[params] == best["_q"]).select(group, F.lit(None).cast("double").alias("tuned"), F.col(score).alias("fixed"))
    return tuned.unionByName(fixed).rollup(group).agg(F.avg("tuned").alias("tuned"), F.avg("fixed").alias("fixed")).withColumn("gain", F.col("tuned") - F.col("fixed"))
