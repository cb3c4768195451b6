"""Group statistics, shares, shrinkage, shift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions.scalars import bin_by, hash_uniform, remap, uniform_sql
from tallyard.operators import shift
from tallyard.operators import stats as s

from .panel import PAIRS, PANEL, SEATS, pairs, panel, seats, table
from .registry import query

EDGES, LABELS = [0.03, 0.04, 0.05], ["rare", "uncommon", "common", "staple"]
SHARE = PANEL + ", c AS (SELECT role, period, item, count(*) AS n FROM panel GROUP BY ALL), g AS (SELECT role, period, sum(n) AS a FROM c GROUP BY ALL), sh AS (SELECT c.role, c.period, c.item, n / a AS share FROM c JOIN g USING (role, period)), x AS (SELECT p.*, share, CASE WHEN share < 0.03 THEN 'rare' WHEN share < 0.04 THEN 'uncommon' WHEN share < 0.05 THEN 'common' ELSE 'staple' END AS bin FROM panel p JOIN sh USING (role, period, item))"


def r(c, name, n=6):
    return F.round(c, n).alias(name)


def binned(spark, d):
    return s.item_share(panel(spark, d), "item", ["role", "period"]).withColumn("bin", bin_by("share", EDGES, LABELS))


@query("A1_leaderboard", f"WITH {PANEL} SELECT item, role, count(*) AS n, round(avg(win), 6) AS avg_win, round(avg(y), 4) AS avg_y FROM panel GROUP BY 1, 2 HAVING count(*) >= 400")
def leaderboard(spark, d):
    return s.leaderboard(panel(spark, d), ["item", "role"], ["win", "y"], 400).select("item", "role", "n", r("avg_win", "avg_win"), r("avg_y", "avg_y", 4))


@query("A2_most_frequent", f"WITH {PANEL} SELECT role, count(*) AS n FROM panel GROUP BY 1 ORDER BY n DESC, role LIMIT 1")
def most_frequent(spark, d):
    return s.most_frequent(panel(spark, d), "role")


@query("A3_outcome_by_bin", f"WITH {SHARE} SELECT bin, count(*) AS n, round(avg(win), 6) AS mean FROM x GROUP BY 1")
def outcome_by_bin(spark, d):
    return s.outcome_by_bin(binned(spark, d), "bin", "win").select("bin", "n", r("mean", "mean"))


@query("A4_distinct_counts", f"WITH {PANEL} SELECT role, period, count(DISTINCT item) AS items, count(DISTINCT entity) AS entities FROM panel GROUP BY 1, 2")
def distinct_counts(spark, d):
    return panel(spark, d).groupBy("role", "period").agg(F.countDistinct("item").alias("items"), F.countDistinct("entity").alias("entities"))


@query("A5_item_share", f"WITH {SHARE} SELECT role, period, item, round(max(share), 9) AS share, count(*) AS n FROM x GROUP BY 1, 2, 3")
def item_share(spark, d):
    return binned(spark, d).groupBy("role", "period", "item").agg(F.round(F.max("share"), 9).alias("share"), F.count("*").alias("n"))


@query("A6_pick_rate", f"WITH {PANEL}, a AS (SELECT period, item, count(DISTINCT contest) AS n FROM panel GROUP BY 1, 2), b AS (SELECT period, count(DISTINCT contest) AS n_contests FROM panel GROUP BY 1) SELECT period, item, n, n_contests, round(n / n_contests, 9) AS rate FROM a JOIN b USING (period)")
def pick_rate(spark, d):
    return s.pick_rate(panel(spark, d), "contest", "item", "period").withColumn("rate", F.round("rate", 9))


@query("A7_familiarity", f"WITH {PANEL}, a AS (SELECT entity, item, count(*) AS n FROM panel GROUP BY 1, 2), b AS (SELECT entity, sum(n) AS m FROM a GROUP BY 1) SELECT entity, item, n, round(n / m, 9) AS familiarity FROM a JOIN b USING (entity)")
def familiarity(spark, d):
    f = s.familiarity(panel(spark, d), "entity", "item")
    return f.groupBy("entity", "item").agg(F.count("*").alias("n"), F.round(F.max("familiarity"), 9).alias("familiarity"))


@query("A8_concentration", f"WITH {PANEL}, c AS (SELECT entity, item, count(*) AS c FROM panel GROUP BY 1, 2), t AS (SELECT entity, sum(c) AS n FROM c GROUP BY 1) SELECT entity, CAST(max(n) AS BIGINT) AS n, count(*) AS n_items, round(-sum(c / n * log2(c / n)), 6) AS entropy, round(pow(2, -sum(c / n * log2(c / n))), 6) AS effective_pool, round(max(c / n), 6) AS top_share FROM c JOIN t USING (entity) GROUP BY 1")
def concentration(spark, d):
    return s.concentration(panel(spark, d), ["entity"], "item").select("entity", "n", "n_items", r("entropy", "entropy"), r("effective_pool", "effective_pool"), r("top_share", "top_share"))


@query("A9_top_k", f"WITH {PANEL}, c AS (SELECT role, item, count(*) AS n FROM panel GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, item) AS rank FROM c) SELECT role, item, n, rank FROM k WHERE rank <= 5")
def top_k(spark, d):
    return s.top_k(panel(spark, d), ["role"], "item", 5)


@query("A10_off_mode", f"WITH {PANEL}, c AS (SELECT entity, role, count(*) AS n FROM panel GROUP BY 1, 2), m AS (SELECT entity, role AS mode FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY n DESC, role) AS k FROM c) WHERE k = 1) SELECT entity, mode, count(*) AS n, CAST(sum(CASE WHEN role <> mode THEN 1 ELSE 0 END) AS BIGINT) AS off FROM panel JOIN m USING (entity) GROUP BY 1, 2")
def off_mode(spark, d):
    return s.off_mode(panel(spark, d), "entity", "role").groupBy("entity", "mode").agg(F.count("*").alias("n"), F.sum(F.col("off_mode").cast("long")).alias("off"))


@query("A11_pair_effect", f"WITH {PAIRS}, b AS (SELECT item, avg(diff) AS base FROM pairs GROUP BY 1), c AS (SELECT item, opp_item, count(*) AS n, avg(diff) AS mean FROM pairs GROUP BY 1, 2 HAVING count(*) >= 5) SELECT item, opp_item, n, round(n / (n + 6) * (mean - base), 4) AS effect FROM c JOIN b USING (item)")
def pair_effect(spark, d):
    return s.pair_effect(pairs(spark, d), "item", "opp_item", "diff").select("item", "opp_item", "n", r("effect", "effect", 4))


@query("A12_shrunk_mean", f"WITH {PANEL} SELECT entity, round(sum(y) / (count(y) + 20) + 1e-7, 4) AS shrunk FROM panel GROUP BY 1")
def shrunk_mean(spark, d):
    return s.shrunk_mean(panel(spark, d), "entity", "y", 20).select("entity", r(F.col("shrunk") + 1e-7, "shrunk", 4))  # sums of cents often end in a tie of the last digit


@query("A13_loo_mean", f"WITH {PANEL} SELECT contest, panel.ln AS line, pk, sk, round((sum(y) OVER (PARTITION BY entity) - y) / greatest(count(y) OVER (PARTITION BY entity) - 1, 1) + 1e-6, 3) AS loo FROM panel")
def loo_mean(spark, d):
    return s.loo_mean(panel(spark, d), "entity", "y").select("contest", F.col("ln").alias("line"), "pk", "sk", r(F.col("loo") + 1e-6, "loo", 3))


@query("A14_spread_by_rarity", f"WITH {SHARE} SELECT bin, count(*) AS n, round(avg(y), 4) AS mean, round(stddev_pop(y), 4) AS spread FROM x GROUP BY 1")
def spread_by_rarity(spark, d):
    return s.spread_by_bin(binned(spark, d), "bin", "y").select("bin", "n", r("mean", "mean", 4), r("spread", "spread", 4))


@query("A15_quantiles", f"WITH {PANEL} SELECT role, round(quantile_cont(y, 0.05), 6) AS q05, round(quantile_cont(y, 0.5), 6) AS q50, round(quantile_cont(y, 0.95), 6) AS q95 FROM panel GROUP BY 1")
def quantiles(spark, d):
    return s.quantiles(panel(spark, d), ["role"], "y", [0.05, 0.5, 0.95]).select("role", r("q05", "q05"), r("q50", "q50"), r("q95", "q95"))


@query("A16_complete_contests", f"WITH {SEATS}, b AS (SELECT contest, side, string_agg(DISTINCT role, ',' ORDER BY role) AS sig FROM seats WHERE role IN ('ECONOMY', 'SMALL') GROUP BY 1, 2) SELECT contest FROM b GROUP BY contest HAVING count(*) = 2 AND min(CASE WHEN sig = 'ECONOMY,SMALL' THEN 1 ELSE 0 END) = 1")
def complete_contests(spark, d):
    rows = seats(panel(spark, d)).filter(F.col("role").isin("ECONOMY", "SMALL"))
    return s.complete_contests(rows, "contest", "side", "role", ["ECONOMY", "SMALL"])


@query("A17_lanes_wide", f"WITH {SEATS}, w AS (SELECT contest, min(CASE WHEN role = 'ECONOMY' THEN y END) AS economy, min(CASE WHEN role = 'SMALL' THEN y END) AS small FROM seats GROUP BY 1) SELECT * FROM w WHERE economy IS NOT NULL AND small IS NOT NULL")
def lanes_wide(spark, d):
    w = s.lanes_wide(seats(panel(spark, d)), "contest", "role", ["ECONOMY", "SMALL"], "y")
    return w.select("contest", F.col("ECONOMY").alias("economy"), F.col("SMALL").alias("small"))


@query("A18_team_context", f"WITH {PANEL}, x AS (SELECT *, sum(y) OVER (PARTITION BY contest, side) AS team, CASE WHEN role = 'SMALL' THEN y ELSE 0.0 END AS own FROM panel) SELECT contest, x.ln AS line, pk, sk, round(team, 2) AS team, round(team - y, 2) AS rest, round(team - y - (sum(own) OVER (PARTITION BY contest, side) - own), 2) AS rest_plain FROM x")
def team_context(spark, d):
    t = s.team_context(panel(spark, d), "contest", "side", "role", "y", "SMALL")
    plain = lambda c: (F.round(c, 2) + 0.0).alias(c)
    return t.select("contest", F.col("ln").alias("line"), "pk", "sk", plain("team"), plain("rest"), plain("rest_plain"))


TVD = PANEL + """, c AS (SELECT period, item, count(*) AS c FROM panel GROUP BY 1, 2), t AS (SELECT period, sum(c) AS n, row_number() OVER (ORDER BY period) AS ord FROM c GROUP BY 1 HAVING sum(c) >= 600),
 sh AS (SELECT period, ord, item, c / n AS share FROM c JOIN t USING (period)), pp AS (SELECT a.period AS period_a, b.period AS period_b, a.ord AS oa, b.ord AS ob FROM t a JOIN t b ON b.ord > a.ord),
 it AS (SELECT DISTINCT item FROM panel), tv AS (SELECT period_a, period_b, CAST(ob - oa AS INT) AS gap, 0.5 * sum(abs(coalesce(p.share, 0) - coalesce(q.share, 0))) AS tvd FROM pp CROSS JOIN it
 LEFT JOIN sh p ON p.period = period_a AND p.item = it.item LEFT JOIN sh q ON q.period = period_b AND q.item = it.item GROUP BY ALL)"""


def tvd_all(spark, d):
    return shift.tvd_pairs(panel(spark, d), "period", "item", 600)


@query("A25_tvd", f"WITH {TVD} SELECT period_a, period_b, round(tvd, 9) AS tvd FROM tv WHERE gap = 1")
def tvd(spark, d):
    return shift.tvd_pairs(panel(spark, d), "period", "item", 600, consecutive=True).select("period_a", "period_b", r("tvd", "tvd", 9))


@query("A26_half_life", f"WITH {TVD}, f AS (SELECT period_a, min(gap) AS life FROM tv WHERE tvd > 0.02 GROUP BY 1) SELECT count(*) AS n, median(life) AS median, round(avg(life), 6) AS mean FROM f")
def half_life(spark, d):
    return shift.half_life(tvd_all(spark, d), "period_a", 0.02).select("n", "median", r("mean", "mean"))


@query("A27_shift_by_season", f"WITH {TVD} SELECT CASE WHEN period_a < 1996 THEN 'early' ELSE 'late' END AS season, count(*) AS n, round(avg(tvd), 9) AS mean FROM tv WHERE gap = 1 GROUP BY 1")
def shift_by_season(spark, d):
    t = shift.tvd_pairs(panel(spark, d), "period", "item", 600, consecutive=True)
    return t.groupBy(F.when(F.col("period_a") < 1996, "early").otherwise("late").alias("season")).agg(F.count("*").alias("n"), F.round(F.avg("tvd"), 9).alias("mean"))


@query("A27_largest_shifts", f"WITH {TVD} SELECT period_a, period_b, round(tvd, 9) AS tvd FROM tv WHERE gap = 1 ORDER BY tvd DESC, period_a LIMIT 4")
def largest_shifts(spark, d):
    return shift.largest_shifts(shift.tvd_pairs(panel(spark, d), "period", "item", 600, consecutive=True), 4).select("period_a", "period_b", r("tvd", "tvd", 9))


@query("A28_corr", f"WITH {PANEL} SELECT role, round(corr(y, win), 6) AS r FROM panel GROUP BY 1")
def corr(spark, d):
    return panel(spark, d).groupBy("role").agg(F.round(F.corr("y", "win"), 6).alias("r"))


@query("A29_pooled_slope", f"WITH {PANEL} SELECT count(*) AS n, round(regr_slope(y, p), 4) AS slope, round(corr(p, y), 6) AS r FROM panel")
def pooled_slope(spark, d):
    return s.pooled_slope(panel(spark, d), "p", "y").select("n", r("slope", "slope", 4), r("r", "r"))


@query("A30_split_half", f"""WITH {PAIRS}, h AS (SELECT item, opp_item, diff, {uniform_sql('half', 'contest')} < 0.5 AS first FROM pairs),
 m AS (SELECT item, opp_item, avg(CASE WHEN first THEN diff END) AS a, avg(CASE WHEN NOT first THEN diff END) AS b, count(CASE WHEN first THEN 1 END) AS na, count(CASE WHEN NOT first THEN 1 END) AS nb FROM h GROUP BY 1, 2)
 SELECT count(*) AS n_pairs, round(corr(a, b), 6) AS r FROM m WHERE na >= 5 AND nb >= 5""")
def split_half(spark, d):
    from tallyard.operators.resample import split_half as op

    return op(pairs(spark, d), ["item", "opp_item"], "contest", "diff", 5, "half").select("n_pairs", r("r", "r"))


@query("A41_top_groups", f"WITH {PANEL} SELECT entity, count(*) AS n, round(quantile_cont(y, 0.5), 4) AS median FROM panel GROUP BY 1 HAVING count(*) >= 40 ORDER BY quantile_cont(y, 0.5) DESC, entity LIMIT 6")
def top_groups(spark, d):
    return s.top_groups(panel(spark, d), "entity", "y", 6, 40).select("entity", "n", r("median", "median", 4))


@query("A41_strong_vs_rest", f"""WITH {PAIRS}, top AS (SELECT entity FROM panel GROUP BY 1 HAVING count(*) >= 40 ORDER BY quantile_cont(y, 0.5) DESC, entity LIMIT 200)
 SELECT entity IN (SELECT entity FROM top) AND opp_entity IN (SELECT entity FROM top) AS both_strong, count(*) AS n, round(avg(abs(diff)), 4) AS gap FROM pairs GROUP BY 1""")
def strong_vs_rest(spark, d):
    top = s.top_groups(panel(spark, d), "entity", "y", 200, 40).select("entity", F.lit(True).alias("strong"))
    rows = pairs(spark, d).join(top, "entity", "left").withColumnRenamed("strong", "own").join(top.withColumnRenamed("entity", "opp_entity"), "opp_entity", "left")
    flag = F.coalesce(F.col("own"), F.lit(False)) & F.coalesce(F.col("strong"), F.lit(False))
    return rows.groupBy(flag.alias("both_strong")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs("diff")), 4).alias("gap"))


@query("A42_coverage", f"WITH {PANEL}, n AS (SELECT entity, item, count(*) AS n FROM panel WHERE period < 1997 GROUP BY 1, 2) SELECT count(*) AS n, round(avg(CASE WHEN n.n >= 1 THEN 1.0 ELSE 0.0 END), 6) AS cover1, round(avg(CASE WHEN n.n >= 3 THEN 1.0 ELSE 0.0 END), 6) AS cover3 FROM panel LEFT JOIN n USING (entity, item) WHERE period >= 1997")
def coverage(spark, d):
    from tallyard.operators.metrics import coverage as op

    p = panel(spark, d).withColumn("key", F.concat_ws("|", F.col("entity").cast("string"), "item"))
    return op(p.filter("period < 1997"), p.filter("period >= 1997"), "key", [1, 3]).select("n", r("cover1", "cover1"), r("cover3", "cover3"))
