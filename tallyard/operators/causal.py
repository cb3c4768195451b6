"""Within-entity contrasts, slopes with fixed effects, bootstraps over clusters."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import poisson_weights, seed_pair

from .stats import quantiles


#: Rows that are weighed at once, and groups whose sums a task holds before it hands them on.
WEIGHED = 128
OPEN_GROUPS = 64


class Sums:
    """The sums of one group for each draw; seen: whether a draw has taken a value at all."""

    def __init__(self, key: list[pa.Array], values: int, draws: int):
        self.key, self.rows = key, 0
        self.sums, self.seen = np.zeros((values, draws)), np.zeros((values, draws), bool)

    def add(self, v: np.ndarray, known: np.ndarray, weight: np.ndarray) -> None:
        """v, known: (rows, values); weight: (rows, draws)."""
        finite = np.isfinite(v)
        self.rows += len(v)
        self.sums += np.where(known & finite, v, 0.0).T @ weight
        for row, k in np.argwhere(known & ~finite):  # these count in the draws that take them alone
            taken = weight[row] > 0
            self.sums[k, taken] += weight[row, taken] * v[row, k]
        if not self.seen.all():
            self.seen |= known.T.astype(float) @ weight > 0


def resampled(per: DataFrame, cluster: str, values: list[str], reps: int, seed, by: list[str] = (), whole: bool = False) -> DataFrame:
    """(rep, by, values): the sums of each draw, in which every cluster weighs a Poisson number of mean 1; null where a draw takes no value.

    per: rows summed beforehand (a row or a few for each cluster).  Weights come from a hash, so there is no join and no numbering of
    clusters; a task multiplies blocks of rows with the weights of all draws and hands on one row for each draw and group.
    whole: a row more, rep -1, in which every row weighs 1, and a column rows, how many rows of per it has (null in the draws).
    """
    a, b = seed_pair(seed, cluster)
    rows = per.select(*by, a.alias("_a"), b.alias("_b"), *[F.col(v).cast("double").alias(v) for v in values])
    first = -1 if whole else 0
    draws = np.arange(first, reps, dtype=np.int64)

    def walk(batches):
        held: dict[tuple, Sums] = {}
        buffer = np.ones((WEIGHED, len(draws)))

        def out():
            for own in held.values():
                cells = [pa.array(x, mask=~k) for x, k in zip(own.sums, own.seen)]
                counts = pa.array(np.where(draws < 0, own.rows, 0), mask=draws >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(draws), *[pa.concat_arrays([k] * len(draws)) for k in own.key], *cells, counts], names=["rep", *by, *values, "rows"])
            held.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, WEIGHED):
                part = batch.slice(lo, WEIGHED)
                v = np.column_stack([part.column(c).to_numpy(zero_copy_only=False).astype(float) for c in values])
                known = np.column_stack([~part.column(c).is_null().to_numpy(zero_copy_only=False) for c in values])
                weight = buffer[: len(v)]
                weight[:, -first:] = poisson_weights(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("_a", "_b")), reps)
                codes = np.column_stack([np.zeros(len(v), int), *[part.column(c).dictionary_encode().indices.fill_null(-1).to_numpy() for c in by]])
                _, firsts, of = np.unique(codes, axis=0, return_index=True, return_inverse=True)
                for k, at in enumerate(map(int, firsts)):
                    own = np.flatnonzero(of.ravel() == k) if len(firsts) > 1 else slice(None)
                    name = tuple(part.column(c)[at].as_py() for c in by)
                    if name not in held:
                        if len(held) >= OPEN_GROUPS:
                            yield from out()
                        held[name] = Sums([part.column(c).slice(at, 1) for c in by], len(values), len(draws))
                    held[name].add(v[own], known[own], weight[own])
        yield from out()

    kinds = dict(per.dtypes)
    schema = ", ".join(["rep long", *[f"`{c}` {kinds[c]}" for c in by], *[f"`{c}` double" for c in values], "rows long"])
    out = rows.mapInArrow(walk, schema).groupBy("rep", *by).agg(*[F.sum(v).alias(v) for v in values], F.sum("rows").alias("rows"))
    return out if whole else out.drop("rows")


def interval(draws: DataFrame, value, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The percentiles of a value over the draws (some thousand rows)."""
    return draws.select(value.alias("_v")).agg(F.percentile("_v", F.lit(low)).alias("low"), F.percentile("_v", F.lit(high)).alias("high"))


def boot_parts(parts: DataFrame, cluster, a: str, b: str, reps: int, seed, low: float, high: float) -> DataFrame:
    """boot_ratio of rows that hold the sums a and b of a cluster each: the estimate and the draws come from one pass."""
    ratio, drawn = F.try_divide(a, b), F.col("rep") >= 0
    percentile = lambda q: F.percentile(F.when(drawn, ratio), F.lit(q))
    found = resampled(parts, cluster, [a, b], reps, seed, whole=True)
    return found.agg(F.max(F.when(~drawn, ratio)).alias("estimate"), F.coalesce(F.max("rows"), F.lit(0)).alias("n_clusters"), percentile(low).alias("low"), percentile(high).alias("high"))


def boot_ratio(df: DataFrame, cluster: str, a: str, b: str, reps: int = 1000, seed="boot", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """One row: estimate sum(a) / sum(b), and its percentile interval over Poisson draws of clusters."""
    return boot_parts(df.groupBy(cluster).agg(F.sum(a).alias("_x"), F.sum(b).alias("_y")), cluster, "_x", "_y", reps, seed, low, high)


def boot_mean(df: DataFrame, cluster: str, v: str, reps: int = 1000, seed="boot", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """The mean of one value per cluster, with its interval."""
    return boot_ratio(df.filter(F.col(v).isNotNull()).withColumn("_one", F.lit(1.0)), cluster, v, "_one", reps, seed, low, high)


def boot_r2(df: DataFrame, cluster: str, y: str, yhat: str, reps: int, seed="boot") -> DataFrame:
    """R2 per draw from weighted sums per cluster: 1 - SSE / (sum y^2 - (sum y)^2 / n)."""
    e = F.col(y) - F.col(yhat)
    per = df.groupBy(cluster).agg(F.count("*").alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"), F.sum(e * e).alias("e"))
    return interval(resampled(per, cluster, ["n", "s", "q", "e"], reps, seed), 1 - F.try_divide(F.col("e"), F.col("q") - F.col("s") * F.col("s") / F.col("n")))


def boot_auc(df: DataFrame, cluster: str, score: str, label: str, reps: int, seed="boot", ranges: int | None = None) -> DataFrame:
    """The AUC's percentile interval over Poisson draws of clusters; tied scores are averaged, null scores rank lowest.

    The cells (cluster, score) are sorted over tasks by score and cluster, so that a score that many clusters share spreads over tasks too.
    A task walks its cells in blocks with a vector of all draws' running sums, and gives for each draw the sums of its first
    score, of its last and of what lies between.  Pieces of one score that several tasks hold are added up, and a window of at most three
    rows a task puts each draw together: the shuffle holds the cells and draws x tasks, not draws x cells.
    ranges: tasks of the walk (spark.sql.shuffle.partitions).
    """
    cells = df.groupBy(cluster, score).agg(F.coalesce(F.sum(F.col(label).cast("double")), F.lit(0.0)).alias("_p"), F.coalesce(F.sum(1 - F.col(label).cast("double")), F.lit(0.0)).alias("_q"))
    a, b = seed_pair(seed, cluster)
    rows = cells.select(F.col(score).cast("double").alias("at"), a.alias("a"), b.alias("b"), "_p", "_q")
    rows = rows.repartitionByRange(ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at", "a", "b").sortWithinPartitions("at")

    def walk(batches):
        first = last = last_at = None
        zero = np.zeros(reps)
        p_open, q_open, w_in, p_in, q_in = (zero.copy() for _ in range(5))
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                at = part.column("at")
                code = score_codes(at)
                a, b, p, q = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "_p", "_q"))
                weight = poisson_weights(a, b, reps)
                starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
                if len(starts) <= 64:  # few scores: a product each
                    sums = [np.stack([p[i:j], q[i:j]]) @ weight[i:j].astype(float) for i, j in zip(starts, [*starts[1:], len(code)])]
                    ps, qs = (np.array([s[k] for s in sums]) for k in (0, 1))
                else:
                    ps, qs = (np.add.reduceat(v[:, None] * weight, starts, axis=0) for v in (p, q))
                if last is not None and code[0] == last:
                    ps[0] += p_open
                    qs[0] += q_open
                elif last is not None:
                    ps, qs, starts = np.vstack([p_open, ps]), np.vstack([q_open, qs]), np.concatenate([[-1], starts])
                closed = slice(0, len(ps) - 1)
                if len(ps) > 1 and first is None:
                    first = (last_at if starts[0] < 0 or code[0] == last else at[0].as_py(), ps[0], qs[0])
                    closed = slice(1, len(ps) - 1)
                pc, qc = ps[closed], qs[closed]
                w_in += (pc * (q_in + np.cumsum(qc, axis=0) - qc / 2)).sum(0)
                p_in += pc.sum(0)
                q_in += qc.sum(0)
                p_open, q_open, last, last_at = ps[-1], qs[-1], code[-1], at[part.num_rows - 1].as_py()
        if last is None:
            return
        pieces = [(last_at, 0, zero, p_open, q_open)]
        if first is not None:
            pieces += [(first[0], 0, zero, *first[1:]), (first[0], 1, w_in, p_in, q_in)]
        for at, kind, w, p, q in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(reps)), pa.array([at] * reps, pa.float64()), pa.array(np.full(reps, kind, np.int32)), *map(pa.array, (w, p, q))], names=["rep", "at", "kind", "w", "p", "q"])

    pieces = rows.mapInArrow(walk, "rep long, at double, kind int, w double, p double, q double")
    pieces = pieces.groupBy("rep", "at", "kind").agg(*[F.sum(c).alias(c) for c in "wpq"])
    own = F.when(F.col("kind") == 0, F.col("p") * F.col("q") / 2).otherwise(F.col("w"))
    below = F.sum("q").over(Window.partitionBy("rep").orderBy(F.col("at").asc_nulls_first(), "kind")) - F.col("q")
    draws = pieces.withColumn("w", own + F.col("p") * below).groupBy("rep").agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("q")).alias("auc"))
    return interval(draws, F.col("auc"))


def score_codes(at: pa.Array) -> np.ndarray:
    """Equal numbers for equal scores: the bits of a score, with one zero and one NaN; the bits of -0.0 stand for null."""
    values = at.to_numpy(zero_copy_only=False).astype(float) + 0.0
    values[np.isnan(values)] = np.nan
    code = values.view(np.int64).copy()
    code[at.is_null().to_numpy(zero_copy_only=False)] = np.iinfo(np.int64).min
    return code


def within_parts(df: DataFrame, entity: str, x: str, y: str, min_rows: int) -> DataFrame:
    """Per entity: the centred sums num (x with y) and den (x with x).

    min_rows counts all rows of the entity; two valid ones and some variation of x are needed besides.
    """
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    vx, vy = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    g = df.groupBy(entity).agg(F.count("*").alias("rows"), F.count(vx).alias("n"), F.sum(vx).alias("sx"), F.sum(vy).alias("sy"), F.sum(vx * vy).alias("sxy"), F.sum(vx * vx).alias("sxx"))
    g = g.filter((F.col("rows") >= min_rows) & (F.col("n") >= 2))
    out = g.select(entity, "n", (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")).alias("num"), (F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")).alias("den"))
    return out.filter(F.col("den") > 1e-9)


def within_slope(df: DataFrame, entity: str, x: str, y: str, min_rows: int = 10) -> DataFrame:
    return within_parts(df, entity, x, y, min_rows).agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_rows"), F.try_divide(F.sum("num"), F.sum("den")).alias("slope"))


def entity_deltas(df: DataFrame, entity: str, y: str, a, b) -> DataFrame:
    """Per entity with both: mean of y where a minus where b; a row with both masks is in a."""
    rows = df.withColumn("_a", F.when(a, F.col(y))).withColumn("_b", F.when(~F.coalesce(a, F.lit(False)) & b, F.col(y)))
    return rows.groupBy(entity).agg(F.avg("_a").alias("mean_a"), F.avg("_b").alias("mean_b")).filter("mean_a is not null and mean_b is not null").withColumn("delta", F.col("mean_a") - F.col("mean_b"))


def within_contrast(df: DataFrame, entity: str, y: str, a, b) -> DataFrame:
    return entity_deltas(df, entity, y, a, b).agg(F.count("*").alias("n_entities"), F.avg("delta").alias("delta"))


def one_way_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """The slope after group means are taken out of both columns."""
    return within_slope(df, group, x, y, 1)


def fe_slope(df: DataFrame, groups: list[str], x: str, y: str, rounds: int = 50, tol: float = 1e-6) -> DataFrame:
    """The slope after the means of several groupings are taken out in turn (alternating projection).

    Rows are summed once to cells of the groupings, which hold all that the means and the slope need.  The cells are
    dealt by the first grouping, the one with most values, and kept that way: its means and its joins then move effects, never cells.
    Each round gives every grouping new effects from the cells and the others' effects; each is written as a table in
    the shared folder, so plans stay short.
    """
    from tallyard.sources.readers import stored

    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.filter(a.isNotNull() & b.isNotNull())
    cells = stored(rows.groupBy(*groups).agg(F.count("*").alias("_n"), F.sum(a).alias("_sx"), F.sum(b).alias("_sy"), F.sum(a * a).alias("_sxx"), F.sum(a * b).alias("_sxy")), "fe-cells")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = cells.repartition(tasks, groups[0]).sortWithinPartitions(groups[0]).persist(StorageLevel.DISK_ONLY)
    effects: dict[str, DataFrame] = {}

    def shifted(without: str | None = None) -> DataFrame:
        out, c, d = cells, F.lit(0.0), F.lit(0.0)
        for g, e in effects.items():
            if g != without:
                out = out.join(e, g)
                c, d = c + F.col(f"_x_{g}"), d + F.col(f"_y_{g}")
        return out.withColumn("_c", c).withColumn("_d", d)

    slope = None
    for _ in range(rounds):
        for g in groups:
            mean = lambda s, c: (F.sum(F.col(s) - F.col("_n") * F.col(c)) / F.sum("_n"))
            effects[g] = stored(shifted(g).groupBy(g).agg(mean("_sx", "_c").alias(f"_x_{g}"), mean("_sy", "_d").alias(f"_y_{g}")), "fe-effects")
        n, c, d = F.col("_n"), F.col("_c"), F.col("_d")
        num = F.sum(F.col("_sxy") - c * F.col("_sy") - d * F.col("_sx") + n * c * d)
        den = F.sum(F.col("_sxx") - 2 * c * F.col("_sx") + n * c * c)
        out = shifted().agg(F.sum("_n").alias("n_rows"), F.try_divide(num, den).alias("slope"))
        found = out.first()
        now = found["slope"]
        if now is None or (slope is not None and abs(now - slope) <= tol * max(1.0, abs(now))):
            break
        slope = now
    cells.unpersist()
    return df.sparkSession.createDataFrame([found], out.schema)


def ols(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, coefficient) of least squares with an intercept: one aggregate of products, a small solve on the driver."""
    cols = ["_one", *xs]
    rows = df.select(*[F.col(c).cast("double") for c in xs], F.col(y).cast("double").alias("_y")).dropna().withColumn("_one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    s = rows.agg(*[F.sum(F.col(cols[i]) * F.col(cols[j])).alias(f"p{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col("_y")).alias(f"y{i}") for i, c in enumerate(cols)]).first()
    a = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        a[i, j] = a[j, i] = s[f"p{i}_{j}"]
    beta = np.linalg.lstsq(a, np.array([s[f"y{i}"] for i in range(len(cols))]), rcond=None)[0]
    return df.sparkSession.createDataFrame([(t, float(b)) for t, b in zip(["intercept", *xs], beta)], "term string, coefficient double")


def quantile_split(df: DataFrame, side, rarity: str, y: str, high: float, low: float) -> DataFrame:
    """Per side: mean outcome of rows above the high quantile of rarity and below the low one, and their difference."""
    rows = df.withColumn("_side", side)
    names = [f"q{round(100 * v):02d}" for v in (high, low)]
    q = quantiles(rows, ["_side"], rarity, [high, low]).select("_side", F.col(names[0]).alias("_h"), F.col(names[1]).alias("_l"))
    j = rows.join(q, "_side")
    up, down = F.col(rarity) > F.col("_h"), F.col(rarity) < F.col("_l")
    return j.groupBy(F.col("_side").alias("side")).agg(F.count("*").alias("n"), F.count(F.when(up, 1)).alias("n_high"), F.count(F.when(down, 1)).alias("n_low"), F.avg(F.when(up, F.col(y))).alias("high"), F.avg(F.when(down, F.col(y))).alias("low")).withColumn("diff", F.col("high") - F.col("low"))


def two_way_table(df: DataFrame, a: str, b: str, y: str) -> DataFrame:
    """(a, b, n, mean, share of all rows)."""
    cells = df.groupBy(a, b).agg(F.count("*").alias("n"), F.avg(y).alias("mean"))
    total = cells.agg(F.sum("n").alias("_all"))
    return cells.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def all_of(*conditions):
    return reduce(lambda p, q: p & q, conditions)
