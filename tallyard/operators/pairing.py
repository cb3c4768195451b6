"""Joins of contests, sides, periods and parameter grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_contest(fact: DataFrame, contests: DataFrame, fact_key: str, contest_key: str, how: str = "inner") -> DataFrame:
    """Fact rows with the attributes of their contest; how='left' keeps rows without one."""
    return fact.join(contests, fact[fact_key] == contests[contest_key], how)


def pair_opponents(df: DataFrame, contest: str, side: str, role: str, measures: list[str], names: list[str] = ()) -> DataFrame:
    """Each row with the row of the same contest and role on the other side: opp_<name>, <measure>_diff."""
    other = df.select(F.col(contest).alias("_c"), F.col(role).alias("_r"), F.col(side).alias("_s"), *[F.col(n).alias(f"opp_{n}") for n in names], *[F.col(m).alias(f"_o_{m}") for m in measures])
    both = df.join(other, (df[contest] == other["_c"]) & (df[role] == other["_r"]) & (df[side] != other["_s"]))
    return both.select(*df.columns, *[f"opp_{n}" for n in names], *[(F.col(m) - F.col(f"_o_{m}")).alias(f"{m}_diff") for m in measures])


def sides_to_wide(df: DataFrame, contest: str, side: str, sides: list[str], value: str) -> DataFrame:
    """One row per contest with a summed value for each side."""
    return df.groupBy(contest).pivot(side, sides).agg(F.sum(value))


def lookup(df: DataFrame, dim: DataFrame, keys: list[str], col: str, default=None) -> DataFrame:
    """df with dim's column by key; the default where there is none.  Spark broadcasts dim if its measured size allows."""
    joined = df.join(dim.select(*keys, col), keys, "left")
    return joined if default is None else joined.withColumn(col, F.coalesce(F.col(col), F.lit(default)))


def keep_valid(df: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    return df.join(valid.select(key), key, "left_semi")


def missing(required: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return required.join(done.select(key), key, "left_anti")


def near(a: DataFrame, b: DataFrame, key: str, at: str, d: float) -> DataFrame:
    """Rows of a that have a row of b with the same key within d: a range join by buckets of width d.

    Each row of b stands in three buckets and each row of a in one, so this is an equi-join on (key, bucket).
    """
    left = a.withColumn("_bucket", F.floor(F.col(at) / d))
    right = b.select(F.col(key).alias("_k"), F.col(at).alias("_t")).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("_t") / d) + i)))
    hit = (left[key] == right["_k"]) & (left["_bucket"] == right["_b"]) & (F.abs(left[at] - right["_t"]) <= d)
    return left.join(right, hit, "left_semi").drop("_bucket")


def near_pairs(a: DataFrame, b: DataFrame, key: str, at: str, d: float, names: list[str] = ()) -> DataFrame:
    """The matching pairs of ``near``: a's columns, other_<at> and other_<name>."""
    left = a.withColumn("_bucket", F.floor(F.col(at) / d))
    right = b.select(F.col(key).alias("_k"), F.col(at).alias(f"other_{at}"), *[F.col(n).alias(f"other_{n}") for n in names]).withColumn("_b", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col(f"other_{at}") / d) + i)))
    hit = (left[key] == right["_k"]) & (left["_bucket"] == right["_b"]) & (F.abs(left[at] - right[f"other_{at}"]) <= d)
    return left.join(right, hit).drop("_bucket", "_k", "_b")


def at_offset(frames: DataFrame, keys: list[str], index: str, value: str, m: int, order: str | None = None) -> DataFrame:
    """The value at index m, or at the last index before it; order: the column whose greatest value is last, if not index."""
    return frames.filter(F.col(index) <= m).groupBy(*keys).agg(F.max_by(value, order or index).alias(value))


def with_grid(df: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row with every setting of a parameter grid (a few rows made by the caller)."""
    return df.crossJoin(F.broadcast(grid))


def later_pairs(df: DataFrame, order: str, cols: list[str]) -> DataFrame:
    """Pairs of ordered periods: each with every later one.  df has a row per period."""
    numbered = df.withColumn("ord", F.row_number().over(Window.orderBy(order)))
    a = numbered.select(F.col("ord").alias("ord_a"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = numbered.select(F.col("ord").alias("ord_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
    return a.join(b, F.col("ord_b") > F.col("ord_a")).withColumn("gap", F.col("ord_b") - F.col("ord_a"))


def prior_in_series(df: DataFrame, series: list[str], order: list[str], contest: str, item: str) -> DataFrame:
    """(contest, item) for the items that earlier contests of the same series used.

    Contests are numbered where their rows lie, so all steps group by the series and rows move once.
    """
    rows = df.select(*series, *order, contest, item).distinct()
    rows = rows.withColumn("game", F.dense_rank().over(Window.partitionBy(*series).orderBy(*order, contest)))
    games = rows.select(*series, contest, "game").distinct()
    first = rows.filter(F.col(contest).isNotNull()).groupBy(*series, item).agg(F.min("game").alias("_first"))
    later = games.join(first, [*series], "inner").filter(F.col("game") > F.col("_first"))
    return later.select(contest, item)
