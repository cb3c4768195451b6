"""Within-entity contrasts, slopes, bootstraps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions.scalars import PRIME, poisson_sql
from tallyard.operators import causal as c
from tallyard.operators import resample as rs
from tallyard.operators import stats as s

from .panel import PANEL, panel
from .registry import query

REPS = 1000


def r(c, n=6):
    return F.round(c, n).alias(c)


def draws_sql(parts: str, key: str, sums: str, seed: str, by: str = "") -> str:
    """b: sums over the Poisson draws (weight w) of the rows of parts, which key names; by: further keys of the sums."""
    y, x, w = poisson_sql("s1", "s2", "rep")
    part = lambda at: f"('0x' || substr(h, {at}, 8))::UBIGINT::BIGINT % {PRIME}"
    return f"""hs AS (SELECT *, md5('{seed}|' || CAST({key} AS VARCHAR)) AS h FROM {parts}), sd AS (SELECT *, {part(1)} AS s1, {part(9)} AS s2 FROM hs), ys AS (SELECT *, {y} AS y FROM sd, (SELECT unnest(range({REPS})) AS rep)), xs AS (SELECT *, {x} AS x FROM ys),
 wt AS (SELECT *, {w} AS w FROM xs), b AS (SELECT rep{by}, {sums} FROM wt WHERE w > 0 GROUP BY rep{by})"""


def boot_sql(parts: str, key: str, num: str, den: str, seed: str, low: float, high: float) -> str:
    """The bootstrap of sum(num) / sum(den) over the rows of parts."""
    return f"{draws_sql(parts, key, f'sum(w * {num}) / sum(w * {den}) AS r', seed)}, ci AS (SELECT quantile_cont(r, {low}) AS low, quantile_cont(r, {high}) AS high FROM b)"


@query("R2_boot_ratio", f"WITH {PANEL}, pa AS (SELECT entity, sum(win) AS a, sum(1.0::DOUBLE) AS n FROM panel GROUP BY entity), {boot_sql('pa', 'entity', 'a', 'n', 'r2', 0.025, 0.975)} SELECT round((SELECT sum(a) / sum(n) FROM pa), 6) AS estimate, (SELECT count(*) FROM pa) AS n_clusters, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def boot_ratio(spark, d):
    return c.boot_ratio(panel(spark, d).withColumn("one", F.lit(1.0)), "entity", "win", "one", REPS, "r2").select(r("estimate"), "n_clusters", r("low"), r("high"))


DELTAS = PANEL + """, cc AS (SELECT entity, item, count(*) AS n FROM panel GROUP BY 1, 2), tt AS (SELECT entity, sum(n) AS a FROM cc GROUP BY 1), fm AS (SELECT entity, item, n / a AS f FROM cc JOIN tt USING (entity)),
 de AS (SELECT entity, avg(CASE WHEN f >= 0.1 THEN win END) AS ma, avg(CASE WHEN f <= 0.03 THEN win END) AS mb FROM panel JOIN fm USING (entity, item) GROUP BY 1), dd AS (SELECT entity, ma - mb AS delta FROM de WHERE ma IS NOT NULL AND mb IS NOT NULL)"""


def deltas(spark, d):
    f = s.familiarity(panel(spark, d), "entity", "item")
    return c.entity_deltas(f, "entity", "win", F.col("familiarity") >= 0.1, F.col("familiarity") <= 0.03)


@query("R3_boot_mean", f"WITH {DELTAS}, pa AS (SELECT entity, delta, 1.0::DOUBLE AS n FROM dd), {boot_sql('pa', 'entity', 'delta', 'n', 'r3', 0.025, 0.975)} SELECT round((SELECT avg(delta) FROM pa), 6) AS estimate, (SELECT count(*) FROM pa) AS n_clusters, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def boot_mean(spark, d):
    return c.boot_mean(deltas(spark, d), "entity", "delta", REPS, "r3").select(r("estimate"), "n_clusters", r("low"), r("high"))


R4_SUMS = "sum(w * n) AS n, sum(w * s) AS s, sum(w * q) AS q, sum(w * e) AS e"


@query("R4_boot_r2", f"""WITH {PANEL}, ev AS (SELECT contest, y AS v, avg(y) OVER (PARTITION BY role) AS yhat FROM panel),
 pr AS (SELECT contest, count(*) AS n, sum(v) AS s, sum(v * v) AS q, sum((v - yhat) * (v - yhat)) AS e FROM ev GROUP BY 1), {draws_sql('pr', 'contest', R4_SUMS, 'r4')}
 SELECT round(quantile_cont(1 - e / (q - s * s / n), 0.025), 6) AS low, round(quantile_cont(1 - e / (q - s * s / n), 0.975), 6) AS high FROM b""")
def boot_r2(spark, d):
    p = panel(spark, d)
    p = p.join(p.groupBy("role").agg(F.avg("y").alias("yhat")), "role")
    return c.boot_r2(p, "contest", "y", "yhat", REPS, "r4").select(r("low"), r("high"))


@query("R4_boot_auc", f"""WITH {PANEL}, ce AS (SELECT contest, p, sum(win) AS pos, sum(1 - win) AS neg FROM panel GROUP BY 1, 2), {draws_sql('ce', 'contest', 'sum(w * pos) AS pos, sum(w * neg) AS neg', 'r4', ', p')}, z AS (SELECT *, sum(neg) OVER (PARTITION BY rep ORDER BY p) - neg / 2.0 AS below FROM b),
 u AS (SELECT rep, sum(pos * below) / (sum(pos) * sum(neg)) AS auc FROM z GROUP BY 1) SELECT round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.975), 6) AS high FROM u""")
def boot_auc(spark, d):
    return c.boot_auc(panel(spark, d), "contest", "p", "win", REPS, "r4").select(r("low"), r("high"))


@query("R5_metric_interval", f"WITH {PANEL}, pa AS (SELECT contest, avg(win) AS v, 1.0::DOUBLE AS n FROM panel GROUP BY contest), {boot_sql('pa', 'contest', 'v', 'n', 'r5', 0.05, 0.95)} SELECT round((SELECT avg(v) FROM pa), 6) AS estimate, (SELECT count(*) FROM pa) AS n_clusters, round(low, 6) AS low, round(high, 6) AS high, low <= 0.5 AND high >= 0.5 AS inside FROM ci")
def metric_interval(spark, d):
    return rs.metric_interval(panel(spark, d), "contest", "win", REPS, "r5").select(r("estimate"), "n_clusters", r("low"), r("high"), "inside")


@query("R6_row_interval", f"WITH {PANEL}, pa AS (SELECT contest || '|' || panel.ln || '|' || pk || '|' || sk AS id, sum(win) AS v, sum(1.0::DOUBLE) AS n FROM panel GROUP BY 1), {boot_sql('pa', 'id', 'v', 'n', 'r6', 0.025, 0.975)} SELECT round((SELECT sum(v) / sum(n) FROM pa), 6) AS estimate, (SELECT count(*) FROM pa) AS n_clusters, round(low, 6) AS low, round(high, 6) AS high FROM ci")
def row_interval(spark, d):
    return rs.row_interval(panel(spark, d), ["contest", "ln", "pk", "sk"], "win", REPS, "r6").select(r("estimate"), "n_clusters", r("low"), r("high"))


WITHIN = PANEL + """, ps AS (SELECT entity, count(*) AS rows, count(p) AS n, sum(p) AS sx, sum(y) AS sy, sum(p * y) AS sxy, sum(p * p) AS sxx FROM panel GROUP BY 1), pt AS (SELECT n, sxy - sx * sy / n AS num, sxx - sx * sx / n AS den FROM ps WHERE rows >= 10 AND n >= 2)"""


@query("E1_within_slope", f"WITH {WITHIN} SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_rows, round(sum(num) / sum(den), 4) AS slope FROM pt WHERE den > 1e-9")
def within_slope(spark, d):
    return c.within_slope(panel(spark, d), "entity", "p", "y", 10).select("n_entities", "n_rows", r("slope", 4))


@query("E2_within_contrast", f"WITH {DELTAS} SELECT count(*) AS n_entities, round(avg(delta), 6) AS delta FROM dd")
def within_contrast(spark, d):
    return deltas(spark, d).agg(F.count("*").alias("n_entities"), F.round(F.avg("delta"), 6).alias("delta"))


@query("E3_one_way_slope", f"WITH {PANEL}, x AS (SELECT p - avg(p) OVER (PARTITION BY item) AS x, y - avg(y) OVER (PARTITION BY item) AS y FROM panel) SELECT round(sum(x * y) / sum(x * x), 4) AS slope FROM x")
def one_way_slope(spark, d):
    return c.one_way_slope(panel(spark, d), "item", "p", "y").select(r("slope", 4))


@query("E3_two_way_slope")
def two_way_slope(spark, d):
    return c.fe_slope(panel(spark, d), ["entity", "item"], "p", "y", rounds=50).select("n_rows", r("slope", 4))


@query("E4_ols", f"""WITH {PANEL}, x AS (SELECT y, p AS a, (sum(win) OVER (PARTITION BY entity) - win) / greatest(count(win) OVER (PARTITION BY entity) - 1, 1) AS b FROM panel), s AS (SELECT covar_samp(a, y) AS ay, covar_samp(b, y) AS by_, var_samp(a) AS aa, var_samp(b) AS bb, covar_samp(a, b) AS ab, avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM x),
 c AS (SELECT (bb * ay - ab * by_) / (aa * bb - ab * ab) AS ca, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS cb, my, ma, mb FROM s)
 SELECT 'p' AS term, round(ca, 3) AS coefficient FROM c UNION ALL SELECT 'loo', round(cb, 3) FROM c UNION ALL SELECT 'intercept', round(my - ca * ma - cb * mb, 3) FROM c""")
def ols(spark, d):
    return c.ols(s.loo_mean(panel(spark, d), "entity", "win"), "y", ["p", "loo"]).withColumn("coefficient", F.round("coefficient", 3))


@query("E17_quantile_split", f"""WITH {PANEL}, cc AS (SELECT role, item, count(*) AS n FROM panel GROUP BY 1, 2), ra AS (SELECT role, item, -log10(n / sum(n) OVER (PARTITION BY role)) AS rarity FROM cc), x AS (SELECT win, rarity, p >= 0.5 AS side FROM panel JOIN ra USING (role, item)),
 q AS (SELECT side, quantile_cont(rarity, 0.8) AS h, quantile_cont(rarity, 0.5) AS l FROM x GROUP BY 1) SELECT side, count(*) AS n, count(CASE WHEN rarity > h THEN 1 END) AS n_high, count(CASE WHEN rarity < l THEN 1 END) AS n_low, round(avg(CASE WHEN rarity > h THEN win END) - avg(CASE WHEN rarity < l THEN win END), 6) AS diff FROM x JOIN q USING (side) GROUP BY 1""")
def quantile_split(spark, d):
    p = s.item_share(panel(spark, d), "item", ["role"]).withColumn("rarity", -F.log10("share"))
    return c.quantile_split(p, F.col("p") >= 0.5, "rarity", "win", 0.8, 0.5).select("side", "n", "n_high", "n_low", r("diff"))


TWO = PANEL + ", cc AS (SELECT entity, item, count(*) AS n FROM panel GROUP BY 1, 2), tt AS (SELECT entity, sum(n) AS a FROM cc GROUP BY 1), x AS (SELECT p.*, n / a >= 0.05 AS familiar, p >= 0.5 AS favoured FROM panel p JOIN cc USING (entity, item) JOIN tt USING (entity))"


def two(spark, d):
    return s.familiarity(panel(spark, d), "entity", "item").withColumn("familiar", F.col("familiarity") >= 0.05).withColumn("favoured", F.col("p") >= 0.5)


@query("E18_two_way_table", f"WITH {TWO} SELECT familiar, favoured, count(*) AS n, round(avg(win), 6) AS mean, round(count(*) / (SELECT count(*) FROM x), 6) AS share FROM x GROUP BY 1, 2")
def two_way_table(spark, d):
    return c.two_way_table(two(spark, d), "familiar", "favoured", "win").select("familiar", "favoured", "n", r("mean"), r("share"))


@query("E19_robustness_split", f"WITH {TWO}, mo AS (SELECT entity, role AS mode FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY k DESC, role) AS o FROM (SELECT entity, role, count(*) AS k FROM panel GROUP BY 1, 2)) WHERE o = 1) SELECT role <> mode AS off_mode, count(*) AS n, round(avg(CASE WHEN familiar THEN win END) - avg(CASE WHEN NOT familiar THEN win END), 6) AS delta FROM x JOIN mo USING (entity) GROUP BY 1")
def robustness_split(spark, d):
    o = s.off_mode(two(spark, d), "entity", "role")
    return o.groupBy("off_mode").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("familiar"), F.col("win"))) - F.avg(F.when(~F.col("familiar"), F.col("win"))), 6).alias("delta"))
