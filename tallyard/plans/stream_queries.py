"""Streams, drained and compared with their batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.sources.keyed import KeyedTable
from tallyard.sources.readers import shared_path
from tallyard.streaming import streams as st

from .panel import PICKS, panel, picks, table
from .registry import query


def events(spark, d):
    ev = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ev.withColumn("at", F.unix_micros("ts") / 1e6)


def drained(spark, stream, mode="append"):
    path, mark = shared_path(spark, "stream"), shared_path(spark, "stream-checkpoint")
    st.run_to_table(stream, path, mark, mode)
    return spark.read.schema(stream.schema).parquet(path)


def replay(df, order, path, parts=4):
    """df as a stream in the order of a column: a slice of it for each micro-batch, nulls in the first, in as many files as its rows need."""
    spark = df.sparkSession
    at = F.col(order).cast("double")
    stats = df.agg(F.percentile_approx(at, [k / parts for k in range(1, parts)]).alias("cuts"), F.count("*").alias("n")).first()
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), stats["n"] // (parts * 20_000)))
    of = F.coalesce(sum((F.when(at > c, 1).otherwise(0) for c in stats["cuts"] or ()), F.lit(0)), F.lit(0))
    for k in range(parts):
        df.filter(of == k).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@query("ST1_hit_rate", """WITH w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, round(avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END), 6) AS rate FROM events GROUP BY 1)
 SELECT CAST(epoch(start) AS BIGINT) AS start, n, rate FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def hit_rate(spark, d):
    ev = events(spark, d).withColumn("hit", F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)).select("ts", "at", "hit")
    stream = replay(ev, "at", shared_path(spark, "replay"))
    return drained(spark, st.hit_rate_stream(stream, "ts", "hit", "6 hours", "1 hour")).select(F.unix_seconds("start").alias("start"), "n", F.round("rate", 6).alias("rate"))


MONITORS = """w AS (SELECT event_type AS monitor, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(*) AS n, avg(value) AS rate FROM (SELECT event_type, ts, CASE WHEN user_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS value FROM events) GROUP BY 1, 2),
 c AS (SELECT *, avg(rate) OVER (PARTITION BY monitor ORDER BY start ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS level FROM w WHERE start + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events))"""


@query("ST1_alarms", f"WITH {MONITORS} SELECT monitor, CAST(epoch(start) AS BIGINT) AS start, n, round(rate, 6) AS rate, round(level, 6) AS level, coalesce(rate < level - 0.05, false) AS alarm FROM c")
def alarm_windows(spark, d):
    """A monitor for each kind of event: the share of even users, and an alarm where it falls under the level of the 8 windows before."""
    ev = events(spark, d).withColumn("hit", F.when(F.col("user_id") % 2 == 0, 1.0).otherwise(0.0)).select("ts", "at", "event_type", "hit")
    stream = replay(ev, "at", shared_path(spark, "replay"))
    with st.state_on_disk(spark):
        out = drained(spark, st.alarm_stream(stream, "ts", "hit", "6 hours", "1 hour", 8, 0.05, "event_type"))
    return out.select("monitor", F.unix_seconds("start").alias("start"), "n", F.round("rate", 6).alias("rate"), F.round("level", 6).alias("level"), "alarm")


@query("ST2_decayed_weeks", f"""WITH {PICKS}, c AS (SELECT item, week, count(*) AS c FROM picks GROUP BY 1, 2)
 SELECT a.item, a.week, round(sum(b.c * pow(0.8::DOUBLE, a.week - b.week)), 6) AS after FROM c a JOIN c b ON a.item = b.item AND b.week <= a.week
 WHERE DATE '1992-01-01' + (a.week + 1) * 7 <= (SELECT max(t) - 14 FROM picks) GROUP BY 1, 2""")
def decayed_weeks(spark, d):
    """Weeks closed by the watermark, from a replay whose slices overlap by up to ten days."""
    p = picks(panel(spark, d)).select("item", "week", F.col("t").cast("timestamp").alias("ts"), (F.unix_seconds(F.col("t").cast("timestamp")) + F.pmod(F.xxhash64("contest"), F.lit(10)) * 86400).alias("at"))
    with st.state_on_disk(spark):
        out = drained(spark, st.decayed_weeks(replay(p, "at", shared_path(spark, "replay")), "item", "week", "ts", 0.8, "14 days"))
    return out.select("item", "week", F.round("after", 6).alias("after"))


@query("ST2_decayed_state", f"""WITH {PICKS}, c AS (SELECT item, week, count(*) AS c FROM picks GROUP BY 1, 2)
 SELECT a.item, a.week, round(sum(b.c * pow(0.8::DOUBLE, a.week - b.week)), 6) AS after FROM c a JOIN c b ON a.item = b.item AND b.week <= a.week GROUP BY 1, 2""")
def decayed_state(spark, d):
    p = picks(panel(spark, d)).select("item", "week")
    out = drained(spark, st.decayed_stream(replay(p, "week", shared_path(spark, "replay")), "item", "week", 0.8), "update")
    return out.select("item", "week", F.round("after", 6).alias("after"))


@query("ST3_ingest", "SELECT o_custkey, seq, o_totalprice FROM (SELECT o_custkey, o_orderkey AS seq, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def ingest(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("seq"), "o_totalprice")
    target, mark = KeyedTable(spark, shared_path(spark, "ingest"), o.schema, ["o_custkey"], "seq"), shared_path(spark, "ingest-checkpoint")
    source = shared_path(spark, "replay")
    st.ingest_stream(replay(o.filter("seq % 3 <> 0"), "seq", source, 2), target, mark)
    st.ingest_stream(replay(o.filter("seq % 3 = 0"), "seq", source, 2), target, mark)  # resumes where the first stopped
    return target.read()


@query("ST4_popularity", """WITH s AS (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) - INTERVAL 6 DAY FROM events), (SELECT max(ts) FROM events), INTERVAL 1 DAY)) AS start)
 SELECT CAST(epoch(start) AS BIGINT) AS start, event_type, count(*) AS n FROM s JOIN events ON ts >= start AND ts < start + INTERVAL 7 DAY WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2""")
def popularity(spark, d):
    stream = replay(events(spark, d).select("ts", "at", "event_type"), "at", shared_path(spark, "replay"))
    return drained(spark, st.popularity_stream(stream, "ts", "event_type", "7 days", "1 day", "1 hour")).select(F.unix_seconds("start").alias("start"), "event_type", "n")
