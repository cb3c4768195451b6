"""Event sequences: votes, matching, scores, sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import events as e

from .panel import event_times, table, times_sql
from .registry import query


def r(c, n=6):
    return F.round(c, n).alias(c)


@query("A35_median_run", """WITH c AS (SELECT user_id, event_type AS run, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n, run) AS r, count(*) OVER (PARTITION BY user_id) AS m FROM c)
 SELECT user_id, run, n FROM k WHERE r = floor(m / 2) + 1""")
def median_run(spark, d):
    return e.median_run(table(spark, d, "events").withColumnRenamed("event_type", "run"), "user_id", "run")


@query("A36_event_vote", f"""WITH {times_sql('ref', 'click')}, oth AS (SELECT user_id AS track, (epoch_us(ts) - 1704067200000000) / 1e6 AS sec, event_type AS source FROM events WHERE event_type <> 'click')
 SELECT ref.track, ref.sec, count(DISTINCT source) + 1 AS votes FROM ref JOIN oth ON ref.track = oth.track AND abs(ref.sec - oth.sec) <= 3600 GROUP BY 1, 2 HAVING count(DISTINCT source) + 1 >= 2""")
def event_vote(spark, d):
    others = table(spark, d, "events").filter("event_type <> 'click'").select(F.col("user_id").alias("track"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("sec"), F.col("event_type").alias("source"))
    return e.event_vote(event_times(spark, d, "click").select("track", "sec"), others, "track", "sec", "source", 3600, 2)


@query("A37_candidate_matches", f"WITH {times_sql('a', 'view')}, {times_sql('b', 'click')} SELECT a.track, count(*) AS n_pairs FROM a JOIN b ON a.track = b.track AND abs(a.sec - b.sec) <= 3600 GROUP BY 1")
def candidate_matches(spark, d):
    return e.candidate_matches(event_times(spark, d, "view"), event_times(spark, d, "click"), "track", "sec", 3600)


@query("A37_event_prf")
def event_prf(spark, d):
    return e.event_prf(event_times(spark, d, "view"), event_times(spark, d, "click"), "track", "sec", 3600).select("track", "n_pred", "n_true", "hits", r("precision"), r("recall"), r("f"))


@query("A38_cemgil", f"""WITH {times_sql('tr', 'click')}, {times_sql('pr', 'view')}, g AS (SELECT tr.track, tr.event_id, min(abs(tr.sec - pr.sec)) AS gap FROM tr LEFT JOIN pr ON tr.track = pr.track GROUP BY 1, 2), n AS (SELECT track, count(*) AS n_pred FROM pr GROUP BY 1)
 SELECT track, count(*) AS n_true, coalesce(max(n_pred), 0) AS n_pred, round(sum(coalesce(exp(-gap * gap / (2 * 1800.0 * 1800.0)), 0)) / ((count(*) + coalesce(max(n_pred), 0)) / 2.0), 6) AS cemgil FROM g LEFT JOIN n USING (track) GROUP BY 1""")
def cemgil(spark, d):
    return e.cemgil(event_times(spark, d, "click"), event_times(spark, d, "view"), "track", "sec", 1800.0).select("track", "n_true", "n_pred", r("cemgil"))


@query("A38_p_score", f"""WITH {times_sql('tr', 'click')}, {times_sql('pr', 'view')}, st AS (SELECT track, sec - lag(sec) OVER (PARTITION BY track ORDER BY sec) AS d FROM tr), re AS (SELECT track, 0.2 * median(d) AS reach, count(*) AS n_true FROM st GROUP BY 1),
 n AS (SELECT track, count(*) AS n_pred FROM pr GROUP BY 1), h AS (SELECT tr.track, count(*) AS hits FROM tr JOIN pr ON tr.track = pr.track JOIN re ON re.track = tr.track WHERE abs(tr.sec - pr.sec) <= reach GROUP BY 1)
 SELECT re.track, n_true, coalesce(n_pred, 0) AS n_pred, round(coalesce(hits, 0) / greatest(n_true, coalesce(n_pred, 0)), 6) AS p_score FROM re LEFT JOIN n USING (track) LEFT JOIN h USING (track)""")
def p_score(spark, d):
    return e.p_score(event_times(spark, d, "click"), event_times(spark, d, "view"), "track", "sec").select("track", "n_true", "n_pred", r("p_score"))


GRID = "gr AS (SELECT user_id, user_id % 10 AS genre, CAST(k AS INT) AS k, CAST(k * 5 AS DOUBLE) AS cut, 1 - abs(value - k * 5) / (value + k * 5 + 1) AS score FROM events, (SELECT unnest(range(1, 7)) AS k))"


def graded(spark, d):
    ev = table(spark, d, "events").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("cut", (F.col("k") * 5).cast("double"))
    return ev.select("user_id", (F.col("user_id") % 10).alias("genre"), "k", "cut", (1 - F.abs(F.col("value") - F.col("cut")) / (F.col("value") + F.col("cut") + 1)).alias("score"))


@query("E20_sweep_by_group", f"WITH {GRID}, a AS (SELECT genre, cut, k, avg(score) AS s FROM gr GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY round(s, 9) DESC, k) AS r FROM a) SELECT genre, cut, round(s, 6) AS score FROM o WHERE r = 1")
def sweep_by_group(spark, d):
    return e.sweep(graded(spark, d), "cut", "k", "score", "genre").select("genre", "cut", r("score"))


@query("E20_sweep_global", f"WITH {GRID}, a AS (SELECT cut, k, avg(score) AS s FROM gr GROUP BY 1, 2) SELECT cut, round(s, 6) AS score FROM a ORDER BY round(s, 9) DESC, k DESC LIMIT 1")
def sweep_global(spark, d):
    return e.sweep(graded(spark, d), "cut", "k", "score", last=True).select("cut", r("score"))


@query("E21_tuning_gain", f"""WITH {GRID}, a AS (SELECT genre, cut, k, avg(score) AS s FROM gr GROUP BY 1, 2, 3), o AS (SELECT genre, cut FROM (SELECT *, row_number() OVER (PARTITION BY genre ORDER BY round(s, 9) DESC, k) AS r FROM a) WHERE r = 1),
 b AS (SELECT cut FROM (SELECT cut, k, avg(score) AS s FROM gr GROUP BY 1, 2) ORDER BY round(s, 9) DESC, k LIMIT 1), t AS (SELECT gr.genre, avg(score) AS tuned, count(*) AS n, sum(score) AS sm FROM gr JOIN o USING (genre, cut) GROUP BY 1), f AS (SELECT genre, avg(score) AS fixed, sum(score) AS sf FROM gr JOIN b USING (cut) GROUP BY 1)
 SELECT genre, round(tuned, 6) AS tuned, round(fixed, 6) AS fixed, round(tuned - fixed, 6) AS gain FROM t JOIN f USING (genre) UNION ALL SELECT NULL, round(sum(sm) / sum(n), 6), round(sum(sf) / sum(n), 6), round(sum(sm) / sum(n) - sum(sf) / sum(n), 6) FROM t JOIN f USING (genre)""")
def tuning_gain(spark, d):
    plus = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return e.tuning_gain(graded(spark, d), "cut", "k", "score", "genre").select("genre", plus("tuned"), plus("fixed"), plus("gain"))
