"""Many logistic fits side by side, and forward tests that fit each event's past.

A row names the fits that it trains.  Every Newton round is one pass: a task adds up loss, gradient and curvature of each fit
by products of matrices and hands on one row for each fit; the driver solves systems as wide as the columns.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.sources.readers import stored

from .causal import resampled
from .metrics import binary_metrics

#: Fits of one job; their coefficients are literals of the plan.
MOST_FITS = 1000


def linear(theta, xs: list[str]):
    """theta[0] + theta[1] * xs[0] + ..."""
    z = theta[0]
    for k, x in enumerate(xs):
        z = z + theta[k + 1] * F.col(x)
    return z


def sigmoid(z):
    return 1 / (1 + F.exp(-z))


def theta_table(spark, theta: dict[int, np.ndarray]) -> DataFrame:
    return spark.createDataFrame([(int(k), [float(c) for c in v]) for k, v in theta.items()], "fit int, theta array<double>")


def newton_sums(batches, xs: list[str], y: str, theta: dict[int, np.ndarray], names: list[str]):
    """For each fit of theta that the rows train: loss, gradient, and the upper half of the curvature, at its coefficients."""
    held: dict[int, np.ndarray] = {}
    upper = np.triu_indices(len(xs) + 1)
    for batch in batches:
        x = np.column_stack([np.ones(batch.num_rows), *[batch.column(c).to_numpy(zero_copy_only=False) for c in xs]])
        label, lists = batch.column(y).to_numpy(zero_copy_only=False), batch.column("fits")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
        for k in np.unique(flat).tolist():
            if k not in theta:
                continue
            own = row[flat == k]
            mine, z = x[own], x[own] @ theta[k]
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-z))
            loss = (np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - label[own] * z).sum()
            found = np.concatenate([[loss], mine.T @ (label[own] - p), (mine.T @ (mine * (p * (1 - p))[:, None]))[upper]])
            held[k] = held[k] + found if k in held else found
    if held:
        table = np.array(list(held.values()))
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), *map(pa.array, table.T)], names=["fit", *names])


def logistic_fits(rows: DataFrame, fits: str, n_fits: int, xs: list[str], y: str, lam: float = 0.0, rounds: int = 30, tol: float = 1e-9) -> dict[int, np.ndarray]:
    """Intercept and coefficients of each fit 0 .. n_fits - 1 that has rows; lam: the ridge on the coefficients, half of its square.

    fits: a column with the array of fits that a row trains.  Rows with a null label or column train nothing.  A step that
    raises the loss is halved; a fit without curvature keeps what it has.
    """
    if n_fits > MOST_FITS:
        raise ValueError(f"{n_fits} fits: more than {MOST_FITS} side by side")
    width = len(xs) + 1
    ready = rows.dropna(subset=[*xs, y]).select(F.col(fits).cast("array<int>").alias("fits"), *[F.col(c).cast("double").alias(c) for c in (*xs, y)])
    cells = [(i, j) for i in range(width) for j in range(i, width)]
    sums = ["loss", *[f"g{i}" for i in range(width)], *[f"h{i}_{j}" for i, j in cells]]
    theta = {k: np.zeros(width) for k in range(n_fits)}
    before = dict(theta)
    best = {k: np.inf for k in theta}
    open_ = set(theta)
    ridge = np.diag([0.0] + [lam] * len(xs))
    for _ in range(rounds):
        live = {k: theta[k] for k in open_}
        passed = ready.mapInArrow(lambda batches, live=live: newton_sums(batches, xs, y, live, sums), ", ".join(["fit int", *[f"{c} double" for c in sums]]))
        found = {r["fit"]: r for r in passed.groupBy("fit").agg(*[F.sum(c).alias(c) for c in sums]).collect()}
        for k in [k for k in open_ if k not in found]:
            open_.discard(k)
            del theta[k]
        for k, r in found.items():
            now = r["loss"] + 0.5 * float(theta[k] @ ridge @ theta[k])
            if now > best[k] + 1e-9 * abs(best[k]) and np.abs(theta[k] - before[k]).max() > tol:
                theta[k] = (theta[k] + before[k]) / 2
                continue
            best[k] = now
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)]) + ridge
            step = np.linalg.lstsq(h, np.array([r[f"g{i}"] for i in range(width)]) - ridge @ theta[k], rcond=1e-12)[0]
            before[k], theta[k] = theta[k], theta[k] + step
            if not np.isfinite(step).all() or np.abs(step).max() <= tol * (1 + np.abs(theta[k]).max()):
                open_.discard(k)
                if not np.isfinite(step).all():
                    theta[k] = before[k]
        if not open_:
            break
    return theta


def forward_fits(df: DataFrame, event: str, time: str, contest: str, cols: list[str], xs: list[str], y: str, lam: float = 1.0, reps: int = 1000, seed="forward") -> tuple[DataFrame, DataFrame]:
    """(scores, coefficients) of every event, tested on its rows after a fit on all rows before its first time.

    A logistic model of xs is fitted for each event; with the probabilities cols it forms an ensemble weighted by accuracy
    on the event's past.  scores: event, start, n, n_contests, n_train, accuracy, log_loss, brier, fitted_accuracy (the
    logistic model alone), low and high (90% interval of the mean of contests' accuracies), inside (1/2 lies in it).
    coefficients: event and theta.  An event without earlier rows has no scores.  Events are counted on the driver: MOST_FITS at most.
    """
    spark = df.sparkSession
    rows = stored(df.select(event, time, contest, *dict.fromkeys([*cols, *xs]), y).filter(F.col(event).isNotNull() & F.col(time).isNotNull()), "forward-rows")
    starts = rows.groupBy(event).agg(F.min(time).alias("start")).orderBy("start", event).limit(MOST_FITS + 1).collect()
    if len(starts) > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} events")
    if not starts:
        return None, None
    marks = F.array(*[F.struct(F.lit(k).alias("fit"), F.lit(r["start"]).alias("start")) for k, r in enumerate(starts)])
    past = rows.withColumn("fits", F.transform(F.filter(marks, lambda m: F.col(time) < m["start"]), lambda m: m["fit"]))
    theta = logistic_fits(past, "fits", len(starts), xs, y, lam)
    names = spark.createDataFrame([(k, r[event], r["start"]) for k, r in enumerate(starts)], f"fit int, {event} {dict(df.dtypes)[event]}, start {dict(df.dtypes)[time]}")
    fitted = names.join(theta_table(spark, theta), "fit")
    every = [*cols, "_lr"]
    right = lambda p: F.when((p >= 0.5) == (F.col(y) == 1), 1.0).otherwise(0.0)
    known = past.select(F.explode("fits").alias("fit"), *dict.fromkeys([*cols, *xs]), y).join(F.broadcast(fitted.select("fit", "theta")), "fit").withColumn("_lr", sigmoid(linear(F.col("theta"), xs)))
    weights = known.groupBy("fit").agg(F.count("*").alias("n_train"), *[F.avg(right(F.col(c))).alias(f"_w{k}") for k, c in enumerate(every)])
    tested = rows.join(F.broadcast(fitted.join(weights, "fit")), event).withColumn("_lr", sigmoid(linear(F.col("theta"), xs)))
    total = sum((F.col(f"_w{k}") for k in range(len(every))), F.lit(0.0))
    mix = sum((F.col(f"_w{k}") * F.col(c) for k, c in enumerate(every)), F.lit(0.0)) / total
    tested = stored(tested.withColumn("_e", mix).withColumn("_hit", right(F.col("_e"))).withColumn("_own", right(F.col("_lr"))).select(event, contest, "start", "n_train", y, "_e", "_hit", "_own"), "forward-tested")
    per = tested.groupBy(event, contest).agg(F.avg("_hit").alias("_v")).withColumn("_one", F.lit(1.0))
    draws = resampled(per, contest, ["_v", "_one"], reps, seed, [event]).withColumn("_m", F.try_divide("_v", "_one"))
    around = draws.groupBy(event).agg(F.percentile("_m", F.lit(0.05)).alias("low"), F.percentile("_m", F.lit(0.95)).alias("high"))
    sums = tested.groupBy(event).agg(F.first("start").alias("start"), F.first("n_train").alias("n_train"), F.avg("_own").alias("fitted_accuracy"))
    counts = per.groupBy(event).agg(F.count("*").alias("n_contests"))
    scores = binary_metrics(tested, y, "_e", [event]).join(sums, event).join(counts, event).join(around, event)
    return scores.withColumn("inside", (F.col("low") <= 0.5) & (F.col("high") >= 0.5)), fitted.select(event, "theta")
