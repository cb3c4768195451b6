"""Distribution shift between periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairing import later_pairs


def period_shares(df: DataFrame, period: str, item: str, min_n: int) -> DataFrame:
    """(period, ord, item, share) of the periods with min_n rows; ord numbers them from 1."""
    cells = df.groupBy(period, item).agg(F.count("*").alias("c"))
    totals = cells.groupBy(period).agg(F.sum("c").alias("n")).filter(F.col("n") >= min_n).withColumn("ord", F.row_number().over(Window.orderBy(period)))
    return cells.join(totals, period).select(period, "ord", item, (F.col("c") / F.col("n")).alias("share"))


def tvd_pairs(df: DataFrame, period: str, item: str, min_n: int, consecutive: bool = False) -> DataFrame:
    """Total variation distance of every earlier period with every later one (or the next): period_a, period_b, gap, tvd.

    The distance is 1 - sum(min(p, q)), so only items in both need to meet: an equi-join on item.
    """
    s = period_shares(df, period, item, min_n)
    periods = s.select(period, "ord").distinct()
    a = s.select(F.col("ord").alias("ord_a"), F.col(item).alias("_i"), F.col("share").alias("p"))
    b = s.select(F.col("ord").alias("ord_b"), F.col(item).alias("_j"), F.col("share").alias("q"))
    wanted = F.col("ord_b") == F.col("ord_a") + 1 if consecutive else F.col("ord_b") > F.col("ord_a")
    common = a.join(b, (F.col("_i") == F.col("_j")) & wanted).groupBy("ord_a", "ord_b").agg(F.sum(F.least("p", "q")).alias("_m"))
    names = later_pairs(periods, period, [period]).filter("gap = 1" if consecutive else "gap >= 1")
    return names.join(common, ["ord_a", "ord_b"], "left").select(f"{period}_a", f"{period}_b", "gap", (1 - F.coalesce("_m", F.lit(0.0))).alias("tvd"))


def half_life(pairs: DataFrame, start: str, cut: float) -> DataFrame:
    """Periods until the distance first exceeds cut: their median and mean over starts."""
    first = pairs.filter(F.col("tvd") > cut).groupBy(start).agg(F.min("gap").alias("life"))
    return first.agg(F.count("*").alias("n"), F.percentile("life", F.lit(0.5)).alias("median"), F.avg("life").alias("mean"))


def largest_shifts(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc(F.round("tvd", 9)), *[c for c in pairs.columns if c.endswith("_a")]).limit(k)


def recall_dip(df: DataFrame, period: str, phase: str, hit: str, early: float, settled: float, min_n: int) -> DataFrame:
    """Per period: hit rates of the early and the settled phase, and settled minus early."""
    e, s = F.col(phase) <= early, F.col(phase) >= settled
    out = df.groupBy(period).agg(F.count(F.when(e, 1)).alias("n_early"), F.count(F.when(s, 1)).alias("n_settled"), F.avg(F.when(e, F.col(hit))).alias("early"), F.avg(F.when(s, F.col(hit))).alias("settled"))
    return out.filter((F.col("n_early") >= min_n) & (F.col("n_settled") >= min_n)).withColumn("dip", F.col("settled") - F.col("early"))
