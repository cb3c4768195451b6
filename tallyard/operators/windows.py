"""Splits, phases, trailing windows, running counts, series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.functions.scalars import hash_uniform, numbered


def rank_split(df: DataFrame, time: str, frac: float, ties: list[str]) -> DataFrame:
    """Adds test: whether the row is among the last frac of all rows in (time, ties) order.

    Counts per time are aggregated and only the rows of the one time that the cut divides are numbered, so no
    task sees all rows.
    """
    per = df.groupBy(time).agg(F.count("*").alias("_n"))
    run = per.withColumn("_upto", F.sum("_n").over(Window.orderBy(time))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    cut = F.floor(F.col("_all") * (1 - frac))
    marked = df.join(run.select(time, (F.col("_upto") - F.col("_n")).alias("_before"), "_upto", cut.alias("_cut")), time)
    divided = (F.col("_before") < F.col("_cut")) & (F.col("_cut") < F.col("_upto"))
    within = F.row_number().over(Window.partitionBy(time).orderBy(*ties))
    whole = marked.filter(~divided).withColumn("test", F.col("_before") >= F.col("_cut"))
    split = marked.filter(divided).withColumn("test", F.col("_before") + within > F.col("_cut"))
    return whole.unionByName(split).drop("_before", "_upto", "_cut")


def date_split(df: DataFrame, contest: str, time: str, frac: float, mode: str = "contest") -> DataFrame:
    """Adds test: whether the contest comes after the first frac of the n contests; mode says where the cut is.

    contest: the date of contest number floor(frac n) in time order; quantile: the date at rank (n - 1) frac, between two dates
    in proportion; row: contest number floor(frac n) itself, those of one date in the order of their keys.  A contest counts once, at its
    first date; without a time it is in neither part (test is null).  Dates are counted; for mode row the contests
    of the one date that the cut divides are sorted over tasks and counted by task before any of them is numbered.
    """
    contests = df.groupBy(contest).agg(F.min(time).alias("_t")).filter("_t is not null")
    dates = contests.groupBy("_t").agg(F.count("*").alias("_n"))
    run = dates.withColumn("_upto", F.sum("_n").over(Window.orderBy("_t"))).withColumn("_all", F.sum("_n").over(Window.partitionBy()))
    if mode == "contest":
        cut = run.filter(F.col("_upto") > F.floor(F.col("_all") * frac)).agg(F.min("_t").alias("_cut"))
        return df.crossJoin(F.broadcast(cut)).withColumn("test", F.col(time) >= F.col("_cut")).drop("_cut")
    if mode == "quantile":
        at = (F.col("_all") - 1) * frac
        number = lambda c: time_number(c, df.schema[time].dataType.typeName())
        low, high = (F.min(F.when(F.col("_upto") > rank, number(F.col("_t")))) for rank in (F.floor(at), F.ceil(at)))
        cut = run.agg(low.alias("_low"), high.alias("_high"), F.max(at - F.floor(at)).alias("_part"))
        edge = F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")
        return df.crossJoin(F.broadcast(cut)).withColumn("test", number(F.col(time)) >= edge).drop("_low", "_high", "_part")
    if mode != "row":
        raise ValueError(f"unknown mode {mode!r}")
    before, number = F.col("_upto") - F.col("_n"), F.floor(F.col("_all") * frac)
    cut = run.filter((before <= number) & (F.col("_upto") > number)).select(F.col("_t").alias("_cut"), (number - before).alias("_k"))
    near = contests.join(F.broadcast(cut), F.col("_t") == F.col("_cut")).select(contest, "_k")
    inside = numbered(near, contest, "_r")
    edge = cut.crossJoin(F.broadcast(inside.filter("_r = _k").agg(F.min(contest).alias("_key")))).agg(F.min("_cut").alias("_cut"), F.min("_key").alias("_key"))
    first = contests.select(F.col(contest).alias("_contest"), "_t").crossJoin(F.broadcast(edge))
    later = F.coalesce((F.col("_t") > F.col("_cut")) | ((F.col("_t") == F.col("_cut")) & (F.col("_contest") >= F.col("_key"))), F.lit(False))
    return df.join(first.select("_contest", later.alias("test")), F.col(contest) == F.col("_contest"), "left").drop("_contest")


def time_number(c, kind: str):
    """A date as days, a time stamp as microseconds, a number as it is."""
    if kind == "date":
        return F.unix_date(c).cast("double")
    return (F.unix_micros(c) if kind == "timestamp" else c).cast("double")


def phase_in_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Adds phase: row number over count in the group.

    Two levels: counts by the first order column place each of its values, and only rows that share one are numbered
    together, so that a large group is no single window.
    """
    cells = df.groupBy(*group, order[0]).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*group)
    cells = cells.withColumn("_before", F.sum("_c").over(w.orderBy(order[0])) - F.col("_c")).withColumn("_n", F.sum("_c").over(w))
    keys = [*group, order[0]]
    same = reduce(lambda a, b: a & b, [F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys])
    rows = df.alias("r").join(cells.alias("c"), same).select("r.*", "_before", "_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order[1:] or [F.lit(0)]))
    return rows.withColumn("phase", (F.col("_before") + inside) / F.col("_n")).drop("_before", "_n")


def half_delta(df: DataFrame, keys: list[str], order: list[str], y: str, min_n: int = 4) -> DataFrame:
    """Per sequence: mean of the late part minus mean of the early floor(n/2) rows."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w)).filter(F.col("_n") >= min_n)
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.when(early, F.col(y))).alias("early"), F.avg(F.when(~early, F.col(y))).alias("late")).withColumn("delta", F.col("late") - F.col("early"))


def trailing_topk(df: DataFrame, role: str, item: str, week: str, back: tuple[int, int], k: int) -> DataFrame:
    """(week, role, item, n, rank): the top items of the weeks [W - back[1], W - back[0]] for each week W."""
    counts = df.groupBy(week, role, item).agg(F.count("*").alias("c"))
    serves = counts.withColumn("_w", F.explode(F.sequence(F.col(week) + back[0], F.col(week) + back[1])))
    weeks = df.select(F.col(week).alias("_w")).distinct()
    total = serves.join(weeks, "_w").groupBy(F.col("_w").alias(week), role, item).agg(F.sum("c").alias("n"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy(week, role).orderBy(F.desc("n"), item))).filter(F.col("rank") <= k)


def decayed_count(df: DataFrame, keys: list[str], week: str, gamma: float) -> DataFrame:
    """(keys, week, before, after): the weight of all earlier weeks' rows, and with this week's, decayed to this week.

    Closed form gamma^w * sum(gamma^-v) over the weeks v of the key, in weeks since the key's first, after one aggregate.
    """
    cells = df.groupBy(*keys, week).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    age = F.col(week) - F.min(week).over(w)
    rows = cells.withColumn("_a", age)
    total = F.sum(F.col("c") * F.pow(F.lit(1 / gamma), F.col("_a"))).over(w.orderBy(week))
    after = F.pow(F.lit(gamma), F.col("_a")) * total
    return rows.withColumn("after", after).withColumn("before", F.col("after") - F.col("c")).select(*keys, week, "c", "before", "after")


def previous_period(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Adds the value of the row before, and the change."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("previous", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("previous"))


def resample(df: DataFrame, series: str, frame: str, value: str, src: float, dst: float) -> DataFrame:
    """(series, out_frame, value): linear interpolation at another rate, clamped to the last frame."""
    n = df.groupBy(series).agg((F.max(frame) + 1).alias("_n"))
    grid = n.withColumn("out_frame", F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("_n") * dst / src).cast("int") - 1, F.lit(0))))).withColumn("_x", F.least(F.col("out_frame") * src / dst, F.col("_n") - 1.0))
    grid = grid.withColumn("_lo", F.floor("_x").cast("int")).withColumn("_hi", F.least(F.col("_lo") + 1, F.col("_n") - 1).cast("int"))
    lo = df.select(F.col(series).alias("_s1"), F.col(frame).alias("_f1"), F.col(value).alias("_v1"))
    hi = df.select(F.col(series).alias("_s2"), F.col(frame).alias("_f2"), F.col(value).alias("_v2"))
    out = grid.join(lo, (grid[series] == lo["_s1"]) & (grid["_lo"] == lo["_f1"])).join(hi, (grid[series] == hi["_s2"]) & (grid["_hi"] == hi["_f2"]))
    return out.select(series, "out_frame", (F.col("_v1") + (F.col("_v2") - F.col("_v1")) * (F.col("_x") - F.col("_lo"))).alias("value"))


def blend(a: DataFrame, b: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """alpha * a + (1 - alpha) * b where both have a frame."""
    other = b.select(*keys, F.col(value).alias("_b"))
    return a.join(other, keys).select(*keys, (alpha * F.col(value) + (1 - alpha) * F.col("_b")).alias(value))


def local_maxima(df: DataFrame, series: str, frame: str, value: str, least: float) -> DataFrame:
    """Frames of at least `least` above both neighbours; a plateau has none (peaks counts its middle)."""
    w = Window.partitionBy(series).orderBy(frame)
    tops = df.withColumn("_l", F.lag(value).over(w)).withColumn("_r", F.lead(value).over(w)).filter((F.col(value) > F.col("_l")) & (F.col(value) > F.col("_r")) & (F.col(value) >= least))
    return tops.select(F.col(series).alias("series"), F.col(frame).cast("long").alias("frame"), F.col(value).cast("double").alias("value"))


def peaks(df: DataFrame, series: str, frame: str, value: str, least: float, gap: int) -> DataFrame:
    """Local maxima of at least `least`, `gap` frames apart, strongest first; a plateau counts at its middle."""
    import numpy as np
    import pandas as pd

    w = Window.partitionBy(series).orderBy(frame)
    # A plateau is a run of equal values; its neighbours are the rows before and after the run.
    new = F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1)
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    flat = runs.groupBy(series, "_run").agg(F.min(frame).alias("_a"), F.max(frame).alias("_b"), F.first(value).alias("_v"))
    wr = Window.partitionBy(series).orderBy("_run")
    tops = flat.withColumn("_l", F.lag("_v").over(wr)).withColumn("_r", F.lead("_v").over(wr)).filter((F.col("_v") > F.col("_l")) & (F.col("_v") > F.col("_r")) & (F.col("_v") >= least))
    maxima = tops.select(F.col(series).alias("series"), F.floor((F.col("_a") + F.col("_b")) / 2).cast("long").alias("frame"), F.col("_v").cast("double").alias("value"))

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["value", "frame"], ascending=[False, True])
        kept: list[int] = []
        for f in pdf["frame"]:
            at = np.searchsorted(kept, f)
            if (at == 0 or f - kept[at - 1] >= gap) and (at == len(kept) or kept[at] - f >= gap):
                kept.insert(at, f)
        return pdf[pdf["frame"].isin(kept)]

    kind = dict(df.dtypes)[series]
    return maxima.groupBy("series").applyInPandas(apart, f"series {kind}, frame long, value double")


def dedupe_first(df: DataFrame, key: list[str], order: list) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def latest_group(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The rows of each key's last date."""
    last = df.groupBy(*keys).agg(F.max(F.to_date(date)).alias("_last"))
    return df.join(last, keys).filter(F.to_date(date) == F.col("_last")).drop("_last")


def random_split(df: DataFrame, group: str, frac: float, seed) -> DataFrame:
    """Adds test by a hash of the group, so no group is on both sides and any partitioning gives the same split."""
    return df.withColumn("test", hash_uniform(seed, group) < frac)


def union_all(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(b.select(*keys).distinct(), keys, "left_anti")


def both(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    return a.join(b.select(*key), key, "left_semi").select(*key).distinct()
