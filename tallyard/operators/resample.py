"""Split-half reliability and intervals of contest-level means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyard.functions.scalars import hash_uniform

from .causal import boot_mean, boot_parts


def split_half(df: DataFrame, key: list[str], unit: str, y: str, min_n: int, seed) -> DataFrame:
    """Correlation over keys of the means of two hashed halves, for keys with min_n rows in each."""
    first = hash_uniform(seed, unit) < 0.5
    m = df.withColumn("_f", first).groupBy(*key).agg(F.avg(F.when(F.col("_f"), F.col(y))).alias("a"), F.avg(F.when(~F.col("_f"), F.col(y))).alias("b"), F.count(F.when(F.col("_f"), 1)).alias("na"), F.count(F.when(~F.col("_f"), 1)).alias("nb"))
    return m.filter((F.col("na") >= min_n) & (F.col("nb") >= min_n)).agg(F.count("*").alias("n_pairs"), F.corr("a", "b").alias("r"))


def metric_interval(df: DataFrame, cluster: str, value: str, reps: int, seed, around: float = 0.5) -> DataFrame:
    """90% interval of the mean of cluster means, and whether `around` lies inside it."""
    per = df.groupBy(cluster).agg(F.avg(value).alias("_v"))
    return boot_mean(per, cluster, "_v", reps, seed, 0.05, 0.95).withColumn("inside", (F.col("low") <= around) & (F.col("high") >= around))


def row_interval(df: DataFrame, row: list[str], hit: str, reps: int, seed) -> DataFrame:
    """The interval of a hit rate over draws of rows; row: the columns that name a row, which are grouped as they are and written out for the hash alone."""
    parts = df.filter(F.col(hit).isNotNull()).groupBy(*row).agg(F.sum(hit).alias("_x"), F.count("*").cast("double").alias("_y"))
    named = parts.select(F.concat_ws("|", *[F.col(k).cast("string") for k in row]).alias("_row"), "_x", "_y")
    return boot_parts(named, "_row", "_x", "_y", reps, seed, 0.025, 0.975)
