"""Streaming monitors and incremental ingest.

Every stream takes a streaming DataFrame and returns one (or starts a sink); batch twins give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tallyard.sources.keyed import KeyedTable


def hit_rate_stream(stream: DataFrame, time: str, hit: str, window: str, lateness: str) -> DataFrame:
    """(start, end, n, rate) of each closed window; rows behind the watermark are dropped."""
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rate")


def alarms(windows: DataFrame, back: int, drop: float) -> DataFrame:
    """Closed windows whose rate lies more than drop below the mean of the `back` windows before (batch)."""
    from pyspark.sql import Window

    before = F.avg("rate").over(Window.orderBy("start").rowsBetween(-back, -1))
    return windows.withColumn("level", before).withColumn("alarm", F.coalesce(F.col("rate") < F.col("level") - drop, F.lit(False)))


class TrailingLevel(StatefulProcessor):
    """Keeps the rates of the last windows; closed windows come in order of time from batch to batch and are put in order inside one."""

    def __init__(self, back: int, drop: float):
        self.back, self.drop = back, drop

    def init(self, handle) -> None:
        self.rates = handle.getListState("rates", "rate double")

    def handleInputRows(self, key, rows, timerValues):
        held = [r[0] for r in self.rates.get()]
        found = pd.concat(list(rows)).sort_values("start", ignore_index=True)
        level = []
        for rate in found["rate"]:
            level.append(reduce(add, held) / len(held) if held else None)  # one after the other, as a window's mean: sum() would compensate
            held = [*held, rate][-self.back :]
        self.rates.put([(float(v),) for v in held])
        found["level"] = pd.Series(level, dtype="float64")
        found["alarm"] = found["rate"] < found["level"] - self.drop
        yield found[["monitor", "start", "end", "n", "rate", "level", "alarm"]]


def alarm_stream(stream: DataFrame, time: str, hit: str, window: str, lateness: str, back: int, drop: float, monitor: str | None = None) -> DataFrame:
    """hit_rate_stream with monitor, level (the mean rate of the windows before) and alarm, decided inside the stream: one state of `back` rates for each monitor."""
    by = F.lit("all") if monitor is None else F.col(monitor).cast("string")
    w = stream.withColumn("monitor", by).withWatermark(time, lateness).groupBy("monitor", F.window(time, window)).agg(F.count("*").alias("n"), F.avg(hit).alias("rate"))
    w = w.select("monitor", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n", "rate")
    schema = "monitor string, start timestamp, end timestamp, n long, rate double, level double, alarm boolean"
    return w.groupBy("monitor").transformWithStateInPandas(TrailingLevel(back, drop), schema, "Append", "None")


def popularity_stream(stream: DataFrame, time: str, item: str, size: str, slide: str, lateness: str) -> DataFrame:
    w = stream.withWatermark(time, lateness).groupBy(F.window(time, size, slide), item).agg(F.count("*").alias("n"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), item, "n")


def decayed_stream(stream: DataFrame, key: str, week: str, gamma: float) -> DataFrame:
    """(key, week, after): the decayed count of each key after each micro-batch's weeks; state is (value, last week).

    Rows of a batch may come in any order.  Rows of a week before the last one add their decayed weight to the last week's
    value, which is given out anew; weeks given out before are not corrected (decayed_weeks waits for late rows instead).
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        value, last = state.get if state.exists else (0.0, None)
        counts = pd.concat(list(frames))[week].value_counts().sort_index()
        after: dict[int, float] = {}
        for w, n in counts.items():
            w = int(w)
            if last is not None and w < last:
                value += int(n) * gamma ** (last - w)
            else:
                value, last = (value * gamma ** (w - last) if last is not None else 0.0) + int(n), w
            after[last] = value
        state.update((float(value), int(last)))
        yield pd.DataFrame({key: [k[0]] * len(after), week: list(after), "after": list(after.values())})

    kind = dict(stream.dtypes)[key]
    return stream.select(key, week).groupBy(key).applyInPandasWithState(update, f"{key} {kind}, {week} int, after double", "value double, last int", "update", "NoTimeout")


DAY_MS = 86_400_000


class DecayedWeeks(StatefulProcessor):
    """Counts of weeks that are still open, the value and number of the last closed week.  A timer at the end of a week closes it
    once the watermark has passed; a key idle for `idle` weeks, whose weight is then nil, is forgotten."""

    def __init__(self, key: str, week: str, gamma: float, origin_ms: int, idle: int):
        self.key, self.week, self.gamma, self.origin, self.idle = key, week, gamma, origin_ms, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "week int", "n long")
        self.value = handle.getValueState("value", "value double, week int")

    def end_of(self, week: int) -> int:
        return self.origin + (week + 1) * 7 * DAY_MS

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            for week, n in frame.groupby(self.week)["n"].sum().items():
                week, held = int(week), 0
                if self.open.containsKey((week,)):
                    held = self.open.getValue((week,))[0]
                else:
                    self.handle.registerTimer(self.end_of(week))
                self.open.updateValue((week,), (held + int(n),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        value, last = self.value.get() if self.value.exists() else (0.0, None)
        closing = sorted(w[0] for w in self.open.keys() if self.end_of(w[0]) <= now)
        weeks, values = [], []
        for w in closing:
            value = (value * self.gamma ** (w - last) if last is not None else 0.0) + self.open.getValue((w,))[0]
            last = w
            self.open.removeKey((w,))
            weeks.append(w)
            values.append(value)
        if weeks:
            self.value.update((value, last))
            self.handle.registerTimer(self.end_of(last + self.idle))
        elif last is not None and now >= self.end_of(last + self.idle) and not any(True for _ in self.open.keys()):
            self.value.clear()
        return iter([pd.DataFrame({self.key: [key[0]] * len(weeks), self.week: weeks, "after": values})] if weeks else ())


def decayed_weeks(stream: DataFrame, key: str, week: str, time: str, gamma: float, lateness: str, origin: str = "1992-01-01", idle: int = 160) -> DataFrame:
    """(key, week, after) of each closed week, in append mode: the rows of the batch twin for these weeks, in whatever order rows come.

    week: weeks since origin (UTC), time: the row's timestamp.  A week closes when the watermark, `lateness` behind the
    latest row, has passed its end; rows later than that are dropped.  Rows are counted by key and week in their tasks
    before they move, so that a frequent key sends one row a task and week.
    """
    kind = dict(stream.dtypes)[key]

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([key, week], as_index=False, dropna=False).agg(n=(time, "size"), at=(time, "max"))

    counted = stream.filter(F.col(time).isNotNull() & F.col(week).isNotNull()).select(key, week, time).mapInPandas(count, f"{key} {kind}, {week} int, n long, at timestamp").withWatermark("at", lateness)
    origin_ms = int(pd.Timestamp(origin, tz="UTC").value // 1_000_000)
    return counted.groupBy(key).transformWithStateInPandas(DecayedWeeks(key, week, gamma, origin_ms, idle), f"{key} {kind}, {week} int, after double", "Append", "EventTime")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Drains a stream's available data into a Parquet folder, one sub-folder per micro-batch, so a retried batch
    overwrites itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest_stream(stream: DataFrame, target: KeyedTable, checkpoint: str) -> None:
    """Merges what is new since the checkpoint into a keyed table, batch by batch."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: target.merge(batch, number) and None).trigger(availableNow=True).start()
    query.awaitTermination()


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Stateful processors keep their state in RocksDB, which their streams ask for."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
