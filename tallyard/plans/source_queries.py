"""Sources and sinks, each driven by rows of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.sources import readers as r
from tallyard.sources.keyed import KeyedTable

from .panel import table
from .registry import query


folder = r.shared_path


@query("S1_read_csvs", "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def read_csvs(spark, d):
    root = folder(spark, "csv")
    r.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), f"{root}/a")
    r.write_csv(table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal")), f"{root}/b")
    return r.read_csvs(spark, [f"{root}/a", f"{root}/b"], "c_custkey bigint, c_name string, c_acctbal double")


@query("S2_read_parquets", "SELECT l_orderkey, l_quantity FROM lineitem UNION ALL SELECT l_orderkey, l_quantity FROM lineitem")
def read_parquets(spark, d):
    return r.read_parquets(spark, [f"{d}/lineitem.parquet", f"{d}/lineitem.parquet"], ["l_orderkey", "l_quantity"])


@query("S3_read_table", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def read_table(spark, d):
    table(spark, d, "nation").createOrReplaceTempView("tallyard_nation")
    return r.read_table(spark, "tallyard_nation").filter("n_regionkey = 1").select("n_nationkey", "n_name")


def match_json(spark, d):
    """Match and timeline records of the orders: one participant per line, frames every minute."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("ls"))
    who = F.transform("ls", lambda x, i: F.struct((i + 1).alias("participantId"), F.concat(F.lit("p"), x["l_suppkey"].cast("string")).alias("puuid"), F.concat(F.lit("c"), (x["l_partkey"] % 25).cast("string")).alias("championName"), F.when(i % 2 == 0, 100).otherwise(200).alias("teamId"), F.lit("MID").alias("teamPosition"), (x["l_quantity"] > 25).alias("win"), F.lit(1).alias("kills"), F.lit(2).alias("deaths"), F.lit(3).alias("assists")))
    match = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("matchId")).alias("metadata"), F.struct(F.lit(420).alias("queueId"), F.lit(1800).alias("gameDuration"), F.lit("14.10.1").alias("gameVersion"), F.lit(1700000000000).alias("gameCreation"), who.alias("participants")).alias("info"))
    minutes = F.sequence(F.lit(0), (F.col("o_orderkey") % 15).cast("int"))
    frame = lambda m: F.struct(F.map_from_entries(F.transform("ls", lambda x, i: F.struct((i + 1).cast("string"), F.struct((x["l_quantity"].cast("int") * 10 + m).alias("totalGold"), m.alias("xp"), (m * 2).alias("minionsKilled"), F.lit(1).alias("jungleMinionsKilled"))))).alias("participantFrames"))
    line = F.struct(F.struct(F.col("o_orderkey").cast("string").alias("matchId")).alias("metadata"), F.struct(F.transform(minutes, frame).alias("frames")).alias("info"))
    return lines.select(F.to_json(match).alias("value")), lines.select(F.to_json(line).alias("value"))


@query("S4_flatten_contests", """WITH x AS (SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS pid FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
 SELECT CAST(l_orderkey AS VARCHAR) AS match_id, 'p' || l_suppkey AS puuid, 'c' || (l_partkey % 25) AS champion, CASE WHEN pid % 2 = 1 THEN 100 ELSE 200 END AS team_id, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS win,
 CAST(l_quantity AS INT) * 10 + CAST(least(10, l_orderkey % 15) AS INT) AS gold10, CAST(2 * least(14, l_orderkey % 15) + 1 AS INT) AS cs14 FROM x""")
def flatten_contests(spark, d):
    matches, timelines = match_json(spark, d)
    root = folder(spark, "json")
    r.write_lines(matches, f"{root}/matches")
    r.write_lines(timelines, f"{root}/timelines")
    return r.read_contests(spark, f"{root}/matches", f"{root}/timelines").select("match_id", "puuid", "champion", "team_id", "win", "gold10", "cs14")


@query("S5_event_text", "SELECT event_id, round(value, 6) AS seconds FROM events")
def event_text(spark, d):
    lines = table(spark, d, "events").select("event_id", F.concat(F.lit("  "), F.col("value").cast("string"), F.lit("\t"), (F.col("event_id") % 4).cast("string")).alias("value"))
    return r.parse_event_text(lines).select("event_id", F.round("seconds", 6).alias("seconds"))


@query("S6_event_json", "SELECT CAST(user_id AS VARCHAR) AS track, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS INT) AS pos, value AS seconds FROM events")
def event_json(spark, d):
    path = folder(spark, "tracks")
    r.write_event_json(table(spark, d, "events"), path, "user_id", "value")
    return r.parse_event_json(spark.read.text(path))


@query("S7_normalise_split", "SELECT CAST(c_custkey AS VARCHAR) AS ID, c_mktsegment AS label, CASE WHEN c_custkey % 3 = 0 THEN 'train' ELSE 'val' END AS \"set\" FROM customer")
def normalise_split(spark, d):
    part = F.when(F.col("c_custkey") % 3 == 0, " Train").when(F.col("c_custkey") % 3 == 1, "DEV ").otherwise("Validation")
    raw = table(spark, d, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias(" ID"), F.col("c_mktsegment").alias("label "), part.alias("set"))
    return r.normalise_split(raw)


@query("S8_write_csv", "SELECT n_nationkey, n_name FROM nation")
def write_csv(spark, d):
    path = folder(spark, "result")
    r.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name"), path)
    return r.read_csvs(spark, path, "n_nationkey int, n_name string")


@query("S9_upsert", "SELECT o_custkey, o_orderkey AS seq, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def upsert(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), "o_totalprice")
    return r.upsert(o.filter("seq % 2 = 0"), o.filter("seq % 2 = 1"), ["o_custkey"], "seq")


@query("S9_merge_into", "SELECT o_custkey, o_orderkey AS seq, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def merge_into(spark, d):
    """Three batches into a stored table, the second of them twice: each rewrites the buckets that it touches."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), "o_totalprice")
    t = KeyedTable(spark, folder(spark, "keyed"), o.schema, ["o_custkey"], "seq", 16)
    for batch in (0, 1, 1, 2):
        t.merge(o.filter(F.col("seq") % 3 == batch), batch)
    return t.read()


@query("S10_parse_log", "SELECT CAST(event_id AS INT) AS epoch, round(value, 3) AS loss, round(CAST(user_id % 100 AS DOUBLE), 3) AS train, round(CAST(user_id % 90 AS DOUBLE), 3) AS val FROM events WHERE event_id % 10 <> 0")
def parse_log(spark, d):
    line = F.when(F.col("event_id") % 10 == 0, "warming up").otherwise(F.format_string("Epoch %03d | loss=%.3f | train=%d.0%% | val=%d.0%%", "event_id", "value", F.col("user_id") % 100, F.col("user_id") % 90))
    return r.parse_log(table(spark, d, "events").select(line.alias("value"))).withColumn("loss", F.round("loss", 3))


@query("S11_list_media", "SELECT event_type AS track, CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS length, count(*) AS n_marks FROM events GROUP BY 1 HAVING event_type <> 'view'")
def list_media(spark, d):
    """Files of each kind of event, listed by size and joined to the marks of that kind; one kind has no marks."""
    root, ev = folder(spark, "media"), table(spark, d, "events")
    ev.select(F.concat(F.lit("type_"), "event_type").alias("kind"), F.col("event_id").cast("string").alias("value")).write.partitionBy("kind").text(root)
    files = r.list_media(spark, root, "*.txt").withColumn("track", F.regexp_extract("path", "kind=type_([^/]*)/", 1)).groupBy("track").agg(F.sum("length").alias("length"))
    marks = ev.filter("event_type <> 'view'").groupBy(F.col("event_type").alias("track")).agg(F.count("*").alias("n_marks"))
    return r.media_with_annotations(files, marks).select("track", "length", "n_marks")


@query("S12_materialize", "SELECT l_returnflag, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1")
def materialize(spark, d):
    root = folder(spark, "derived")
    made = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 2).alias("qty"))
    r.materialize(made, root, {"by": "l_returnflag"})
    return r.materialize(made, root, {"by": "l_returnflag"})
