"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.operators import pairing as j
from tallyard.operators import windows as w

from .panel import PAIRS, PANEL, SEATS, dealt, event_times, pairs, panel, seats, table, tasks_of, times_sql
from .registry import query


@query("J1_contest_join", "SELECT l_orderkey, l_linenumber, l_partkey, o_custkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'")
def contest_join(spark, d):
    rows = j.with_contest(table(spark, d, "lineitem"), table(spark, d, "orders").filter("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "o_custkey", "o_orderstatus")


@query("J2_composite_join", "SELECT a.l_orderkey, a.l_linenumber, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY 1, 2")
def composite_join(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    li = dealt(li, tasks_of(li), "l_orderkey", "l_linenumber")
    return li.join(li.withColumn("_", F.lit(1)), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("J3_left_join", "SELECT d.doc_id, l.quality, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def left_join(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").withColumnRenamed("doc_id", "_id")
    return j.with_contest(docs, labels, "doc_id", "_id", "left").select("doc_id", "quality", F.col("quality").isNull().alias("unlabelled"))


@query("J4_pair_opponents", f"WITH {PAIRS} SELECT contest, role, side, entity, item, opp_entity, opp_item, round(diff, 2) AS diff FROM pairs")
def pair_opponents(spark, d):
    return pairs(spark, d).select("contest", "role", "side", "entity", "item", "opp_entity", "opp_item", F.round("diff", 2).alias("diff"))


@query("J5_three_way", "SELECT n_name, r_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2")
def three_way(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rows.groupBy("n_name", "r_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("J6_sides_to_wide", f"WITH {PANEL} SELECT contest, round(sum(CASE WHEN side = 'F' THEN y END), 2) AS F, round(sum(CASE WHEN side = 'O' THEN y END), 2) AS O FROM panel GROUP BY contest")
def sides_to_wide(spark, d):
    return j.sides_to_wide(panel(spark, d), "contest", "side", ["F", "O"], "y").select("contest", F.round("F", 2).alias("F"), F.round("O", 2).alias("O"))


@query("J7_lookup", "SELECT s_suppkey, coalesce(CASE WHEN n_regionkey <> 2 THEN n_name END, 'unknown') AS n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def lookup(spark, d):
    dim = table(spark, d, "nation").filter("n_regionkey <> 2").withColumnRenamed("n_nationkey", "s_nationkey")
    return j.lookup(table(spark, d, "supplier"), dim, ["s_nationkey"], "n_name", "unknown").select("s_suppkey", "n_name")


@query("J8_keep_valid", "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 300000)")
def keep_valid(spark, d):
    ok = table(spark, d, "orders").filter("o_totalprice > 300000").withColumnRenamed("o_orderkey", "l_orderkey")
    return j.keep_valid(table(spark, d, "lineitem"), ok, "l_orderkey").select("l_orderkey", "l_partkey")


@query("J9_missing", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing(spark, d):
    return j.missing(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("J10_near", f"WITH {times_sql('a', 'click')}, {times_sql('b', 'view')} SELECT event_id FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.track = a.track AND abs(b.sec - a.sec) <= 3600)")
def near(spark, d):
    return j.near(event_times(spark, d, "click"), event_times(spark, d, "view"), "track", "sec", 3600).select("event_id")


@query("J11_at_offset", "SELECT l_orderkey, max_by(l_quantity, (l_linenumber * 1000000 + l_partkey) * 100 + l_quantity) AS qty FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1")
def at_offset(spark, d):
    li = table(spark, d, "lineitem").withColumn("at", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity"))
    return j.at_offset(li, ["l_orderkey"], "l_linenumber", "l_quantity", 3, "at").withColumnRenamed("l_quantity", "qty")


@query("J12_with_grid", f"WITH {PANEL}, g AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS cut) SELECT cut, count(*) AS n, round(avg(CASE WHEN p > cut THEN 1.0 ELSE 0.0 END), 6) AS above FROM panel, g GROUP BY 1")
def with_grid(spark, d):
    grid = spark.createDataFrame([(0.25,), (0.5,), (0.75,)], "cut double")
    return j.with_grid(panel(spark, d).select("p"), grid).groupBy("cut").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("p") > F.col("cut"), 1.0).otherwise(0.0)), 6).alias("above"))


@query("J13_later_pairs", f"WITH {PANEL}, o AS (SELECT period, row_number() OVER (ORDER BY period) AS ord FROM (SELECT DISTINCT period FROM panel)) SELECT a.period AS period_a, b.period AS period_b, CAST(b.ord - a.ord AS INT) AS gap FROM o a JOIN o b ON b.ord > a.ord")
def later_pairs(spark, d):
    return j.later_pairs(panel(spark, d).select("period").distinct(), "period", ["period"]).select("period_a", "period_b", "gap")


@query("J14_prior_in_series", f"""WITH {PANEL}, g AS (SELECT entity, period, t, contest, row_number() OVER (PARTITION BY entity, period ORDER BY t, contest) AS game FROM (SELECT DISTINCT entity, period, t, contest FROM panel)),
 u AS (SELECT DISTINCT entity, period, contest, item FROM panel), h AS (SELECT u.*, game FROM u JOIN g USING (entity, period, contest))
 SELECT DISTINCT b.contest, a.item FROM h a JOIN g b ON a.entity = b.entity AND a.period = b.period AND a.game < b.game""")
def prior_in_series(spark, d):
    n = tasks_of(table(spark, d, "lineitem"))
    return j.prior_in_series(dealt(panel(spark, d).select("entity", "period", "t", "contest", "item"), n, "entity", "period"), ["entity", "period"], ["t"], "contest", "item")


@query("U1_union_all", "SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return w.union_all(c, s)


@query("U2_candidates", f"WITH {PANEL} SELECT item, role FROM panel WHERE period = 1995 UNION SELECT item, role FROM panel WHERE period = 1996")
def candidates(spark, d):
    p = panel(spark, d)
    return w.candidates(p.filter("period = 1995").select("item", "role"), p.filter("period = 1996").select("item", "role"))


@query("U3_minus", f"WITH {PANEL} SELECT DISTINCT entity, item FROM panel WHERE period < 1996 EXCEPT SELECT entity, item FROM panel WHERE period >= 1996")
def minus(spark, d):
    p = panel(spark, d)
    return w.minus(p.filter("period < 1996").select("entity", "item").distinct(), p.filter("period >= 1996"), ["entity", "item"])


@query("U4_both", f"WITH {SEATS} SELECT contest FROM seats WHERE side = 'F' INTERSECT SELECT contest FROM seats WHERE side = 'O'")
def both(spark, d):
    s = seats(panel(spark, d))
    return w.both(s.filter("side = 'F'").select("contest"), s.filter("side = 'O'").select("contest"), ["contest"])
