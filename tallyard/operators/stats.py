"""Group statistics, shares, shrinkage, team context."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyard.sources.readers import stored


def leaderboard(df: DataFrame, keys: list[str], measures: list[str], min_n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in measures]).filter(F.col("n") >= min_n)


def most_frequent(df: DataFrame, col: str) -> DataFrame:
    """One row: the most frequent value (the smallest on ties) and its count."""
    counts = df.groupBy(col).count()
    return counts.orderBy(F.desc("count"), col).limit(1).select(col, F.col("count").alias("n"))


def outcome_by_bin(df: DataFrame, bin_col: str, outcome: str) -> DataFrame:
    return df.groupBy(bin_col).agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"))


def spread_by_bin(df: DataFrame, bin_col: str, outcome: str) -> DataFrame:
    return df.groupBy(bin_col).agg(F.count("*").alias("n"), F.avg(outcome).alias("mean"), F.stddev_pop(outcome).alias("spread"))


def item_share(df: DataFrame, item: str, within: list[str]) -> DataFrame:
    """Adds share: rows of the item in the group over rows of the group.

    Counts are aggregated first and joined back, so no window holds all rows of a popular group.
    """
    cells = df.groupBy(*within, item).agg(F.count("*").alias("_n"))
    totals = cells.groupBy(*within).agg(F.sum("_n").alias("_all"))
    shares = cells.join(totals, within).select(*within, item, (F.col("_n") / F.col("_all")).alias("share"))
    return df.join(shares, [*within, item])


def pick_rate(df: DataFrame, contest: str, item: str, period: str) -> DataFrame:
    """Contests of the period with the item over contests of the period."""
    once = df.select(period, item, contest).distinct()
    used = once.groupBy(period, item).agg(F.count("*").alias("n"))
    games = once.select(period, contest).distinct().groupBy(period).agg(F.count("*").alias("n_contests"))
    return used.join(games, period).withColumn("rate", F.col("n") / F.col("n_contests"))


def familiarity(df: DataFrame, entity: str, item: str) -> DataFrame:
    """Adds familiarity: the share of the entity's rows spent on the item."""
    return item_share(df, item, [entity]).withColumnRenamed("share", "familiarity")


def concentration(df: DataFrame, group: list[str], item: str) -> DataFrame:
    """n, distinct items, entropy in bits, effective pool 2^H and top share of each group."""
    cells = df.groupBy(*group, item).agg(F.count("*").alias("c"))
    total = cells.groupBy(*group).agg(F.sum("c").alias("n"), F.count("*").alias("n_items"), F.max("c").alias("top"), F.sum(F.col("c") * F.log2(F.col("c").cast("double"))).alias("_s"))
    h = F.log2(F.col("n").cast("double")) - F.col("_s") / F.col("n")
    return total.select(*group, "n", "n_items", h.alias("entropy"), F.pow(F.lit(2.0), h).alias("effective_pool"), (F.col("top") / F.col("n")).alias("top_share"))


def top_k(df: DataFrame, group: list[str], item: str, k: int) -> DataFrame:
    counts = df.groupBy(*group, item).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def off_mode(df: DataFrame, entity: str, col: str) -> DataFrame:
    """Adds mode (the entity's most frequent value, smallest on ties) and off_mode."""
    counts = df.groupBy(entity, col).agg(F.count("*").alias("_n"))
    best = counts.withColumn("_r", F.row_number().over(Window.partitionBy(entity).orderBy(F.desc("_n"), col))).filter("_r = 1").select(entity, F.col(col).alias("mode"))
    return df.join(best, entity).withColumn("off_mode", F.col(col) != F.col("mode"))


def pair_effect(df: DataFrame, a: str, b: str, y: str, K: float = 6, min_n: int = 5) -> DataFrame:
    """n/(n+K) * (mean of the cell - mean of a); the mean of a uses all rows, also those of rare cells."""
    base = df.groupBy(a).agg(F.avg(y).alias("base"))
    cell = df.groupBy(a, b).agg(F.count("*").alias("n"), F.avg(y).alias("mean")).filter(F.col("n") >= min_n)
    return cell.join(base, a).withColumn("effect", F.col("n") / (F.col("n") + K) * (F.col("mean") - F.col("base")))


def shrunk_mean(df: DataFrame, key: str, y: str, K: float) -> DataFrame:
    return df.groupBy(key).agg((F.sum(y) / (F.count(y) + K)).alias("shrunk"))


def loo_mean(df: DataFrame, key: str, y: str) -> DataFrame:
    """Adds the mean of the other rows of the key: (sum - y) / max(n - 1, 1)."""
    sums = df.groupBy(key).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    return df.join(sums, key).withColumn("loo", (F.col("_s") - F.col(y)) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_s", "_n")


#: Ranges that a group's values are counted in at a time, and the most values that are sorted together.
RANGES, SORTED = 4096, 4096


def quantiles(df: DataFrame, keys: list[str], y: str, qs: list[float], approximate: bool = False) -> DataFrame:
    """Linear-interpolated quantiles of each group, nulls left out, or approximate ones.

    The exact ones are selected without sorting a group: its values are counted in RANGES equal ranges between its
    ends, the ranges that hold the wanted ranks are cut again until each holds SORTED values or one value, and only
    these are sorted.  NaN values are not expected.
    """
    names = [f"q{round(100 * q):02d}" for q in qs]
    if approximate:
        return df.groupBy(*keys).agg(*[F.percentile_approx(y, q).alias(n) for q, n in zip(qs, names)])
    rows = stored(df.filter(F.col(y).isNotNull()).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(y).cast("double").alias("_y"), F.lit("").alias("_at")), "quantile-rows")
    own = [f"_k{i}" for i in range(len(keys))]
    ends = stored(rows.groupBy(*own, "_at").agg(F.count("*").alias("_n"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi")), "quantile-ends")
    ranks = F.array_distinct(F.array(*[f((F.col("_n") - 1) * F.lit(float(q))) for q in qs for f in (F.floor, F.ceil)]))
    # a segment: a range of one group with the wanted ranks in it and the number of values before it
    segments = ends.select(*own, "_at", "_lo", "_hi", F.col("_n").alias("_c"), F.lit(0).cast("long").alias("_before"), ranks.alias("_ranks"))
    parts = []
    while True:
        is_large = (F.col("_lo") < F.col("_hi")) & (F.col("_c") > SORTED)
        large, found = segments.filter(is_large), segments.agg(F.count_if(is_large).alias("large"), F.count_if(~is_large).alias("small")).first()
        if found["small"] or not found["large"]:
            parts.append(segment_values(rows, segments.filter(~is_large), own))
        if not found["large"]:
            break
        step = F.least(F.floor((F.col("r._y") - F.col("s._lo")) / (F.col("s._hi") - F.col("s._lo")) * RANGES), F.lit(RANGES - 1))
        cut = rows.alias("r").join(large.alias("s"), same_of(own)).select(*[F.col(f"r.{k}").alias(k) for k in own], F.col("r._y").alias("_y"), F.col("s._at").alias("_at"), step.alias("_b"))
        counts = cut.groupBy(*own, "_at", "_b").agg(F.count("*").alias("_c"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi"))
        of = large.select(*own, "_at", F.col("_before").alias("_start"), F.col("_ranks").alias("_wanted"))
        counts = counts.alias("r").join(of.alias("s"), same_of(own)).select("r.*", "_start", "_wanted")
        before = F.sum("_c").over(Window.partitionBy(*own, "_at").orderBy("_b")) - F.col("_c") + F.col("_start")
        counts = counts.withColumn("_before", before).withColumn("_ranks", F.filter("_wanted", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).filter(F.size("_ranks") > 0)
        path = F.concat_ws("/", "_at", F.col("_b").cast("string")).alias("_at")
        segments = stored(counts.select(*own, path, "_lo", "_hi", "_c", "_before", "_ranks"), "quantile-segments")
        rows = cut.select(*own, "_y", path)
    known = reduce(DataFrame.unionByName, parts)
    n = ends.select(*own, "_n")
    pairs = n.alias("n").join(known.alias("v"), reduce(lambda p, q: p & q, [F.col(f"n.{k}").eqNullSafe(F.col(f"v.{k}")) for k in own], F.lit(True)))
    at = lambda q, f: F.max(F.when(F.col("v._rank") == f((F.col("n._n") - 1) * q), F.col("v._v")))
    share = lambda q: F.first((F.col("n._n") - 1) * q - F.floor((F.col("n._n") - 1) * q))
    values = [(at(F.lit(float(q)), F.floor) + (at(F.lit(float(q)), F.ceil) - at(F.lit(float(q)), F.floor)) * share(F.lit(float(q)))).alias(name) for q, name in zip(qs, names)]
    out = pairs.groupBy(*[F.col(f"n.{k}").alias(k) for k in own]).agg(*values)
    return out.select(*[F.col(k).alias(name) for k, name in zip(own, keys)], *names)


def segment_values(rows: DataFrame, segments: DataFrame, own: list[str]) -> DataFrame:
    """(group, _rank, _v) of the wanted ranks of segments that hold one value or are small enough to sort."""
    plain = segments.filter("_lo = _hi").select(*own, F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    groups = [F.col(f"s.{k}").alias(k) for k in own]
    joined = rows.alias("r").join(segments.filter("_lo < _hi").alias("s"), same_of(own))
    each = joined.groupBy(*groups, F.col("s._at").alias("_at")).agg(F.sort_array(F.collect_list("r._y")).alias("_all"), F.first("s._before").alias("_before"), F.first("s._ranks").alias("_ranks"))
    picked = each.select(*own, "_all", "_before", F.explode("_ranks").alias("_rank"))
    return plain.unionByName(picked.select(*own, "_rank", F.element_at("_all", (F.col("_rank") - F.col("_before") + 1).cast("int")).alias("_v")))


def same_of(own: list[str]):
    """Rows r and segments s of one group and range."""
    return reduce(lambda p, q: p & q, [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in own], F.col("r._at") == F.col("s._at"))


def complete_contests(df: DataFrame, contest: str, side: str, role: str, roles: list[str], n_sides: int = 2) -> DataFrame:
    """Contests in which every side shows exactly these roles."""
    want = F.array(*map(F.lit, sorted(roles)))
    per = df.groupBy(contest, side).agg(F.array_sort(F.collect_set(role)).alias("_roles"))
    return per.groupBy(contest).agg(F.count("*").alias("_n"), F.min((F.col("_roles") == want).cast("int")).alias("_ok")).filter((F.col("_n") == n_sides) & (F.col("_ok") == 1)).select(contest)


def lanes_wide(df: DataFrame, contest: str, role: str, roles: list[str], value: str) -> DataFrame:
    """One row per contest with a column per role, complete rows only."""
    return df.groupBy(contest).pivot(role, roles).agg(F.min(value)).dropna()


def team_context(df: DataFrame, contest: str, side: str, role: str, value: str, special: str) -> DataFrame:
    """Adds team total, the rest of the team, and the rest without the special role.  Teams are small."""
    w = Window.partitionBy(contest, side)
    total = F.sum(value).over(w)
    own = F.when(F.col(role) == special, F.col(value)).otherwise(0.0)
    return df.withColumn("team", total).withColumn("rest", F.col("team") - F.col(value)).withColumn("rest_plain", F.col("rest") - (F.sum(own).over(w) - own))


def pooled_slope(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.corr(x, y).alias("r"))


def top_groups(df: DataFrame, group: str, y: str, k: int, min_n: int) -> DataFrame:
    """The k groups with the highest median among those with min_n rows; medians as in `quantiles`, so a large group is never one buffer."""
    n = df.groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= min_n).alias("c")
    median = quantiles(df, [group], y, [0.5]).alias("m")
    med = n.join(median, F.col(f"c.{group}").eqNullSafe(F.col(f"m.{group}")), "left").select(f"c.{group}", "c.n", F.col("m.q50").alias("median"))
    return med.orderBy(F.desc("median"), group).limit(k)
