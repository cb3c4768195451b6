"""Views that give the test tables the shapes of the operators: panel, pairs, picks, event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, where a table is so large that tasks of Spark's own choice, which go by compressed bytes, would hold many more.
TASK_ROWS = 250_000
#: A table of up to so many rows is left to Spark's choice.
SMALL_ROWS = 4_000_000


def tasks_of(df: DataFrame) -> int | None:
    """How many tasks a stored table is dealt to, None if that is left to Spark; its rows are counted from the files' footers."""
    rows = df.count()
    return -(-rows // TASK_ROWS) if rows > SMALL_ROWS else None


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """df by hash of its keys in so many tasks: joins and groups by these keys then stay there, and a task's memory does not grow with the table."""
    return df.repartition(tasks, *keys) if tasks else df


def panel(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """One row per entity, item and contest; those of a contest lie together where the table is large.  orders: with more columns, to be kept."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    n = tasks_of(lines)
    if n:  # parts first: then the rows of a contest are where their order is
        of = dealt(lines, n if tasks_of(parts) else None, "l_partkey").join(dealt(parts, n if tasks_of(parts) else None, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        joined = dealt(of, n, "l_orderkey").join(dealt(orders, n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    else:
        joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    return joined.select(
        F.col("o_custkey").alias("entity"), F.col("p_brand").alias("item"), F.col("p_type").alias("role"), F.year("o_orderdate").alias("period"),
        F.col("o_orderkey").alias("contest"), F.col("l_linestatus").alias("side"), F.to_date("o_orderdate").alias("t"), F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_extendedprice").alias("y"), F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("win"),
        F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.01)), F.lit(0.99)).alias("p"), *more,
    )


PANEL = """panel AS (SELECT o_custkey AS entity, p_brand AS item, p_type AS role, CAST(year(o_orderdate) AS INT) AS period, o_orderkey AS contest,
 l_linestatus AS side, CAST(o_orderdate AS DATE) AS t, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, l_extendedprice AS y,
 CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS win, least(greatest(l_discount * 10, 0.01::DOUBLE), 0.99::DOUBLE) AS p
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def seats(df: DataFrame) -> DataFrame:
    """The strongest row of each contest, role and side."""
    w = Window.partitionBy("contest", "role", "side").orderBy(F.desc("y"), "ln", "pk", "sk")
    return df.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


SEATS = PANEL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY contest, role, side ORDER BY y DESC, ln, pk, sk) AS rn FROM panel),
 seats AS (SELECT * FROM ranked WHERE rn = 1)"""
PAIRS = SEATS + """, pairs AS (SELECT a.contest, a.role, a.side, a.entity, a.item, a.period, a.t, a.y, a.win, b.entity AS opp_entity, b.item AS opp_item, a.y - b.y AS diff
 FROM seats a JOIN seats b ON a.contest = b.contest AND a.role = b.role AND a.side <> b.side)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest rows of both sides of each contest and role, each beside the other: one aggregate, no join of the panel with itself."""
    rows = panel(spark, sf_dir)
    order = [F.col("y"), -F.col("ln"), -F.col("pk"), -F.col("sk")]  # the seat of a side is the greatest of these
    kept = [c for c in rows.columns if c not in ("contest", "role", "side")]
    seat = F.struct(*[o.alias(f"_{k}") for k, o in enumerate(order)], F.struct(*kept).alias("row"))
    per = rows.groupBy("contest", "role").agg(*[F.max(F.when(F.col("side") == s, seat)).alias(s) for s in "FO"]).filter("F is not null and O is not null")
    both = per.withColumn("of", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.row").alias("own"), F.col(f"{o}.row").alias("opp")) for s, o in ("FO", "OF")])))
    return both.select("contest", "role", "of.side", "of.own.*", F.col("of.opp.entity").alias("opp_entity"), F.col("of.opp.item").alias("opp_item"), (F.col("of.own.y") - F.col("of.opp.y")).alias("diff"))


def picks(df: DataFrame) -> DataFrame:
    """The panel as an ordered stream: slot 1, 2, ... of each contest, and a global order of contests."""
    w = Window.partitionBy("contest").orderBy("ln", "pk", "sk")
    return df.withColumn("slot", F.row_number().over(w)).withColumn("week", F.floor(F.datediff("t", F.to_date(F.lit("1992-01-01"))) / 7).cast("int"))


PICKS = PANEL + """, picks AS (SELECT *, row_number() OVER (PARTITION BY contest ORDER BY ln, pk, sk) AS slot,
 CAST(floor(date_diff('day', DATE '1992-01-01', t) / 7.0) AS INT) AS week FROM panel)"""


def event_times(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """(track, sec) of the events of one kind: seconds since 2024."""
    ev = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return ev.select(F.col("user_id").alias("track"), ((F.unix_micros(F.col("ts").cast("timestamp")) - 1704067200000000) / 1e6).alias("sec"), "event_id")


def times_sql(name: str, kind: str) -> str:
    return f"{name} AS (SELECT user_id AS track, (epoch_us(ts) - 1704067200000000) / 1e6 AS sec, event_id FROM events WHERE event_type = '{kind}')"
