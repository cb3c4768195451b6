"""Scalar functions, binning, arrays, segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyard.functions import scalars as s

from .panel import PANEL, panel, table
from .registry import query


def r6(c, name):
    return F.round(c, 6).alias(name)


@query("P1_version_key", """SELECT event_id, CAST(regexp_extract(v, '^(\\d+)\\.(\\d+)', 1) AS INT) AS major, CAST(regexp_extract(v, '^(\\d+)\\.(\\d+)', 2) AS INT) AS minor,
 lpad(regexp_extract(v, '^(\\d+)\\.(\\d+)', 1), 3, '0') || '.' || lpad(regexp_extract(v, '^(\\d+)\\.(\\d+)', 2), 3, '0') AS sort_text
 FROM (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'beta' ELSE CAST(user_id % 15 AS VARCHAR) || '.' || CAST(event_id % 27 AS VARCHAR) || '.1' END AS v FROM events) WHERE regexp_matches(v, '^\\d+\\.\\d+')""")
def version_key(spark, d):
    v = F.when(F.col("event_id") % 50 == 0, "beta").otherwise(F.concat((F.col("user_id") % 15).cast("string"), F.lit("."), (F.col("event_id") % 27).cast("string"), F.lit(".1")))
    e = table(spark, d, "events").select("event_id", v.alias("v")).withColumn("k", s.version_key("v")).filter("k is not null")
    return e.select("event_id", "k.major", "k.minor", s.version_text("v").alias("sort_text"))


@query("P2_id_from_path", r"""SELECT page_id, regexp_replace(regexp_replace(list_extract(string_split(p, '/'), -1), '\.[^.]*$', ''), '\.', '_', 'g') AS id FROM (SELECT page_id, url || '/a.' || page_id || '.b.wav' AS p FROM pages)""")
def id_from_path(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat("url", F.lit("/a."), F.col("page_id").cast("string"), F.lit(".b.wav")).alias("p"))
    return p.select("page_id", s.id_from_path("p").alias("id"))


@query("P3_group_of", "SELECT p_partkey, list_extract(string_split(n, '_'), -1) AS last_part, list_extract(string_split(n, '_'), 1) AS first_part FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)")
def group_of(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.regexp_replace("p_name", " ", "_").alias("n"))
    return p.select("p_partkey", s.group_of("n").alias("last_part"), s.group_of("n", last=False).alias("first_part"))


@query("P4_week_index", "SELECT o_orderkey, CAST(floor(date_diff('day', (SELECT CAST(min(o_orderdate) AS DATE) FROM orders), CAST(o_orderdate AS DATE)) / 7.0) AS INT) AS week FROM orders")
def week_index(spark, d):
    o = table(spark, d, "orders")
    first = o.agg(F.to_date(F.min("o_orderdate")).alias("first"))
    return o.crossJoin(F.broadcast(first)).select("o_orderkey", s.week_index(F.to_date("o_orderdate"), F.col("first")).alias("week"))


@query("P5_days_since_first", "SELECT o_orderkey, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)) OVER (PARTITION BY o_custkey), CAST(o_orderdate AS DATE)) AS INT) AS age_days FROM orders")
def days_since_first(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return s.days_since_first(o, ["o_custkey"], "day").select("o_orderkey", "age_days")


@query("P6_remap", "SELECT n_name, CASE WHEN r_name IN ('AMERICA', 'EUROPE') THEN 'west' WHEN r_name = 'ASIA' THEN 'east' ELSE 'other' END AS bloc FROM nation JOIN region ON n_regionkey = r_regionkey")
def remap(spark, d):
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_name", s.remap("r_name", {"AMERICA": "west", "EUROPE": "west", "ASIA": "east"}, "other").alias("bloc"))


@query("P7_bin_by", "SELECT bin, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most FROM (SELECT l_quantity, CASE WHEN l_quantity < 10 THEN 'low' WHEN l_quantity < 25 THEN 'mid' WHEN l_quantity < 40 THEN 'high' ELSE 'top' END AS bin FROM lineitem) GROUP BY bin")
def bin_by(spark, d):
    b = table(spark, d, "lineitem").select("l_quantity", s.bin_by("l_quantity", [10, 25, 40], ["low", "mid", "high", "top"]).alias("bin"))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))


@query("P8_decile", f"WITH {PANEL} SELECT CAST(least(greatest(floor(p * 10), 0), 9) AS INT) AS decile, count(*) AS n, round(avg(win), 6) AS won FROM panel GROUP BY 1")
def decile(spark, d):
    return panel(spark, d).groupBy(s.decile("p").alias("decile")).agg(F.count("*").alias("n"), r6(F.avg("win"), "won"))


@query("P9_surprisal", f"""WITH {PANEL}, c AS (SELECT role, item, count(*) AS n FROM panel GROUP BY 1, 2), t AS (SELECT role, sum(n) AS a FROM c GROUP BY 1)
 SELECT c.role, item, round(-log10(n / a + 1e-3), 6) AS surprisal, round(-log10(n / a), 6) AS rarity FROM c JOIN t ON c.role = t.role""")
def surprisal(spark, d):
    c = panel(spark, d).groupBy("role", "item").count()
    t = c.groupBy("role").agg(F.sum("count").alias("a"))
    return c.join(t, "role").withColumn("rate", F.col("count") / F.col("a")).select("role", "item", r6(s.surprisal("rate"), "surprisal"), r6(-F.log10("rate"), "rarity"))


@query("P10_logit", f"WITH {PANEL}, c AS (SELECT contest, panel.ln AS line, pk, sk, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS q FROM panel) SELECT contest, line, pk, sk, round(ln(q / (1 - q)), 6) AS logit FROM c")
def logit(spark, d):
    return panel(spark, d).select("contest", F.col("ln").alias("line"), "pk", "sk", r6(s.logit("p"), "logit"))


@query("P11_sigmoid", "SELECT event_id, round(1 / (1 + exp(-value / 10)), 6) AS p FROM events")
def sigmoid(spark, d):
    return table(spark, d, "events").select("event_id", r6(s.sigmoid(F.col("value") / 10), "p"))


@query("P12_filters", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 30 AND l_discount < 0.05 AND l_shipdate IS NOT NULL")
def filters(spark, d):
    f = F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") >= 30) & (F.col("l_discount") < 0.05) & F.col("l_shipdate").isNotNull()
    return table(spark, d, "lineitem").filter(f).select("l_orderkey", "l_linenumber", "l_quantity")


@query("P13_text_match", "SELECT p_partkey, coalesce(regexp_matches(lower(CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_name END), 'ring|widget'), false) AS hit FROM part")
def text_match(spark, d):
    name = F.when(F.col("p_partkey") % 10 == 0, F.lit(None)).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", s.matches(name, "RING|Widget").alias("hit"))


@query("P14_index_categories", "SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS index FROM (SELECT DISTINCT p_brand FROM part)")
def index_categories(spark, d):
    return s.index_categories(table(spark, d, "part"), "p_brand")


@query("P15_signed_features", f"WITH {PANEL} SELECT contest, item, CAST(sum(CASE WHEN side = 'F' THEN 1 ELSE -1 END) AS BIGINT) AS sign FROM panel GROUP BY 1, 2")
def signed_features(spark, d):
    return s.signed_features(panel(spark, d), "contest", "item", "side", "F")


@query("P16_context_features", f"""WITH {PANEL}, x AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY ln, pk, sk) AS slot FROM panel)
 SELECT a.contest, a.slot, concat_ws(':', b.item, b.role, CASE WHEN a.side = b.side THEN 'ally' ELSE 'enemy' END) AS token FROM x a JOIN x b ON a.contest = b.contest AND a.slot <> b.slot""")
def context_features(spark, d):
    from .panel import picks

    return s.context_features(picks(panel(spark, d)), "contest", "side", "role", "item", "slot")


@query("P17_fit_length", "SELECT vec_id, round(list_sum(v), 4) AS total, len(v) AS n FROM (SELECT vec_id, list_resize(CAST(embedding AS DOUBLE[]), 70, 0.0::DOUBLE) AS v FROM embeddings)")
def fit_length(spark, d):
    v = s.fit_length(F.transform("embedding", lambda x: x.cast("double")), 70, 0.0)
    e = table(spark, d, "embeddings").select("vec_id", v.alias("v"))
    return e.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").cast("long").alias("n"))


@query("P18_zscore_array", """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
 s AS (SELECT vec_id, avg(x) AS m, stddev_pop(x) AS sd FROM e GROUP BY 1) SELECT e.vec_id, CAST(i AS INT) AS i, round((x - m) / (sd + 1e-8), 4) AS z FROM e JOIN s ON e.vec_id = s.vec_id""")
def zscore_array(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return e.select("vec_id", F.posexplode(s.zscore_array("v")).alias("i", "z")).withColumn("z", F.round("z", 4))


@query("P19_zscore", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_samp(c_acctbal) FROM customer), 6) AS z FROM customer")
def zscore(spark, d):
    return s.zscore(table(spark, d, "customer"), ["c_acctbal"]).select("c_custkey", F.round("c_acctbal_z", 6).alias("z"))


@query("P20_even_starts", "SELECT doc_id, CAST(i AS INT) AS i, CAST(floor(i * n_chars / 4.0) AS INT) AS start FROM documents, (SELECT unnest(range(5)) AS i)")
def even_starts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(s.even_starts("n_chars", 5)).alias("i", "start"))


HOURS = "h AS (SELECT user_id, CAST(date_diff('hour', TIMESTAMP '2024-01-01', ts) AS INT) AS hour, sum(value) AS level FROM events GROUP BY 1, 2), f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY hour) - 1 AS INT) AS frame, level FROM h)"


def frames(spark, d):
    """A frame series per user: the summed value of each hour that has events, numbered from 0."""
    from pyspark.sql import Window

    e = table(spark, d, "events")
    hour = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 3600000000).cast("int")
    h = e.groupBy("user_id", hour.alias("hour")).agg(F.sum("value").alias("level"))
    return h.withColumn("frame", (F.row_number().over(Window.partitionBy("user_id").orderBy("hour")) - 1).cast("int")).select("user_id", "frame", "level")


@query("P21_segment", f"WITH {HOURS}, n AS (SELECT *, max(frame) OVER (PARTITION BY user_id) + 1 AS n FROM f) SELECT user_id, frame, CAST(floor(frame / 7.0) AS BIGINT) AS segment FROM n WHERE floor(frame / 7.0) < floor(n / 7.0) OR n < 7")
def segment(spark, d):
    return s.segment(frames(spark, d), "user_id", "frame", 7).select("user_id", "frame", "segment")


U = s.uniform_sql


@query("P22_random_crops", f"SELECT vec_id, crop, CAST(floor({U('crops', 'vec_id', 'crop')} * (len(embedding) - 16 + 1)) AS INT) AS start FROM embeddings, (SELECT CAST(unnest(range(1, 4)) AS INT) AS crop)")
def random_crops(spark, d):
    c = s.random_crops(table(spark, d, "embeddings"), "vec_id", "embedding", 3, 16, "crops")
    return c.filter(F.size("window") == 16).select("vec_id", "crop", "start")


@query("P23_mask_spans", f"""SELECT vec_id, {U('mask', 'vec_id', "'on'")} < 0.5 AS masked, CAST(floor({U('mask', 'vec_id', "'at'")} * (len(embedding) - 8 + 1)) AS INT) AS start,
 CAST(CASE WHEN {U('mask', 'vec_id', "'on'")} < 0.5 THEN 8 ELSE 0 END AS BIGINT) AS zeroed FROM embeddings""")
def mask_spans(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double")) + 1).alias("v"))
    m = s.mask_spans(e, "vec_id", "v", 8, 0.5, "mask")
    return m.select("vec_id", "masked", "start", F.size(F.filter("v", lambda x: x == 0)).cast("long").alias("zeroed"))


@query("P24_trim_quiet", f"""WITH {HOURS}, l AS (SELECT user_id, frame, 10 * log10(level + 1e-9) AS db FROM f), m AS (SELECT *, db > max(db) OVER (PARTITION BY user_id) - 6 AS loud FROM l),
 e AS (SELECT *, min(CASE WHEN loud THEN frame END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN loud THEN frame END) OVER (PARTITION BY user_id) AS b FROM m)
 SELECT user_id, frame, round(db, 6) AS db FROM e WHERE b - a + 1 < 5 OR frame BETWEEN a AND b""")
def trim_quiet(spark, d):
    f = frames(spark, d).withColumn("db", 10 * F.log10(F.col("level") + 1e-9))
    return s.trim_quiet(f, "user_id", "frame", "db", 6, 5).select("user_id", "frame", F.round("db", 6).alias("db"))


@query("P25_segment_stats", f"WITH {HOURS} SELECT user_id, CAST(floor(frame / 10.0) AS BIGINT) AS segment, round(avg(level), 6) AS mean, round(stddev_pop(level), 6) AS std FROM f GROUP BY 1, 2")
def segment_stats(spark, d):
    f = frames(spark, d).withColumn("segment", F.floor(F.col("frame") / 10))
    return s.segment_stats(f, ["user_id", "segment"], "level").select("user_id", "segment", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("P26_with_default", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def with_default(spark, d):
    return s.with_default(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id", "quality", -1)


@query("R1_hash_uniform", f"SELECT event_id, round({U('r1', 'user_id', 'event_id')}, 9) AS u FROM events")
def hash_uniform(spark, d):
    return table(spark, d, "events").select("event_id", F.round(s.hash_uniform("r1", "user_id", "event_id"), 9).alias("u"))
