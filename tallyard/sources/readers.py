"""Sources and sinks: typed CSV, parquet, nested contest records, annotation text, event JSON, keyed upserts."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MATCH_SCHEMA = """metadata struct<matchId:string>, info struct<queueId:int, gameDuration:int, gameVersion:string, gameCreation:bigint,
 teams:array<struct<teamId:int, win:boolean>>, participants:array<struct<participantId:int, puuid:string, championName:string,
 teamId:int, teamPosition:string, win:boolean, kills:int, deaths:int, assists:int>>>"""
TIMELINE_SCHEMA = """metadata struct<matchId:string>, info struct<frames:array<struct<participantFrames:map<string, struct<totalGold:int,
 xp:int, minionsKilled:int, jungleMinionsKilled:int>>>>>"""


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder of spark.checkpoint.dir; under a temporary one where the setting is absent (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """As stored(); executors are then told that the shuffles which led to the table are no longer needed, so that their files go before the next ones come."""
    spark, table = df.sparkSession, stored(df, name)
    del df
    spark.sparkContext._jvm.System.gc()  # Spark drops a shuffle's files once the driver's JVM has let go of it
    return table


def read_csvs(spark: SparkSession, paths: list[str] | str, schema: str) -> DataFrame:
    """Several CSV files with a header and one schema."""
    return spark.read.schema(schema).option("header", True).csv(paths)


def write_lines(df: DataFrame, path: str) -> None:
    """A column of text as lines, compressed; spark.read reads them by their names."""
    df.write.option("compression", "gzip").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_parquets(spark: SparkSession, paths: list[str], cols: list[str]) -> DataFrame:
    return spark.read.parquet(*paths).select(*cols)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def flatten_contests(matches: DataFrame, timelines: DataFrame, minutes: tuple[int, ...] = (10, 14)) -> DataFrame:
    """One row per participant, with gold, experience and creeps at the given minutes (or the last frame before them)."""
    people = matches.select(F.col("metadata.matchId").alias("match_id"), F.col("info.queueId").alias("queue"), F.col("info.gameDuration").alias("duration"), F.col("info.gameVersion").alias("version"), F.col("info.gameCreation").alias("game_creation"), F.explode("info.participants").alias("p"))
    flat = people.select("match_id", "queue", "duration", "version", "game_creation", F.col("p.participantId").alias("pid"), F.col("p.puuid").alias("puuid"), F.col("p.championName").alias("champion"), F.col("p.teamId").alias("team_id"), F.col("p.teamPosition").alias("team_position"), F.col("p.win").cast("int").alias("win"), F.col("p.kills").alias("kills"), F.col("p.deaths").alias("deaths"), F.col("p.assists").alias("assists"))
    # Only the wanted frames meet the participants.  get() gives null beyond the ends, so an empty timeline leaves nulls.
    frames = [F.get("info.frames", F.least(F.lit(m), F.size("info.frames") - 1))["participantFrames"].alias(f"_frame{m}") for m in minutes]
    joined = flat.join(timelines.select(F.col("metadata.matchId").alias("match_id"), *frames), "match_id", "left")
    for m in minutes:
        at = F.col(f"_frame{m}")[F.col("pid").cast("string")]
        joined = joined.withColumn(f"gold{m}", at["totalGold"]).withColumn(f"xp{m}", at["xp"]).withColumn(f"cs{m}", at["minionsKilled"] + at["jungleMinionsKilled"])
    return joined.drop("pid", *[f"_frame{m}" for m in minutes])


def read_contests(spark: SparkSession, match_path: str, timeline_path: str, minutes: tuple[int, ...] = (10, 14)) -> DataFrame:
    return flatten_contests(spark.read.schema(MATCH_SCHEMA).json(match_path), spark.read.schema(TIMELINE_SCHEMA).json(timeline_path), minutes)


def parse_event_text(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds seconds: the first of one or two columns of an annotation line."""
    return lines.withColumn("seconds", F.split(F.trim(value), r"\s+")[0].try_cast("double")).filter(F.col("seconds").isNotNull())


def read_event_text(spark: SparkSession, glob: str, prefix: str = "") -> DataFrame:
    """(track, seconds) from annotation files; the track is the file name without a prefix and its extension."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    track = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    lines = spark.read.text(glob).select(track.alias("track"), "value")
    return parse_event_text(lines).select("track", "seconds")


def parse_event_json(docs: DataFrame, value: str = "value") -> DataFrame:
    """(track, pos, seconds) from JSON texts {id: [seconds, ...]}."""
    tracks = docs.select(F.explode(F.from_json(value, "map<string, array<double>>")).alias("track", "times"))
    return tracks.select("track", F.posexplode("times").alias("pos", "seconds"))


def read_event_json(spark: SparkSession, path: str) -> DataFrame:
    return parse_event_json(spark.read.text(path, wholetext=True))


def event_json(df: DataFrame, track: str, seconds: str) -> DataFrame:
    """One JSON object per track: {"<track>": [sorted seconds]}; a file of these lines is read back by read_event_json."""
    rows = df.groupBy(track).agg(F.array_sort(F.collect_list(seconds)).alias("times"))
    return rows.select(F.to_json(F.map_from_arrays(F.array(F.col(track).cast("string")), F.array("times"))).alias("value"))


def write_event_json(df: DataFrame, path: str, track: str = "track", seconds: str = "seconds") -> None:
    event_json(df, track, seconds).write.mode("overwrite").text(path)


def normalise_split(df: DataFrame) -> DataFrame:
    """Trims headers and ids, lower-cases set, and gives the validation set one name."""
    names = {c: c.strip() for c in df.columns}
    out = df.withColumnsRenamed(names)
    part = F.lower(F.trim("set"))
    return out.withColumn("ID", F.trim("ID")).withColumn("set", F.when(part.isin("val", "dev", "valid", "validation"), "val").otherwise(part))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    return normalise_split(spark.read.option("header", True).csv(path))


def upsert(target: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target and updates with one row per key: the one with the highest order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return target.unionByName(updates).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def parse_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """(epoch, loss, train, val) of lines like 'Epoch 001 | loss=.. | train=..% | val=..%'."""
    number = lambda name: F.regexp_extract(value, rf"{name}=\s*([0-9.]+)", 1).try_cast("double")
    rows = lines.select(F.regexp_extract(value, r"Epoch\s+(\d+)", 1).try_cast("int").alias("epoch"), number("loss").alias("loss"), number("train").alias("train"), number("val").alias("val"))
    return rows.filter("epoch is not null and val is not null")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.read.text(path))


def list_media(spark: SparkSession, folder: str, glob: str = "*.wav") -> DataFrame:
    """(track, path, length) of media files under a folder; contents are not read."""
    from tallyard.functions.scalars import id_from_path

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select("path", "length")
    return files.select(id_from_path("path").alias("track"), "path", "length")


def media_with_annotations(media: DataFrame, annotations: DataFrame, track: str = "track") -> DataFrame:
    """Media files that have annotations, with them; files without any and annotations of missing files are left out."""
    return media.join(annotations, track)


def materialize(df: DataFrame, root: str, params: dict) -> DataFrame:
    """df stored under a folder named by its parameters and its plan (the files it reads included), or what an earlier run stored there.

    Spark marks a complete table by its _SUCCESS file, so a half-written one is written anew.
    """
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/param_hash={hashlib.sha256(json.dumps([params, sorted(df.inputFiles()), df.schema.json()], sort_keys=True).encode()).hexdigest()[:16]}"
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
