"""Streaming forms (extensions): bars from ticks, open signals, and latest reviews."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A file stream of an event table."""
    read = spark.readStream.schema("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string")
    return (read if files_at_once is None else read.option("maxFilesPerTrigger", files_at_once)).parquet(path)


def hourly_bars(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """X-01: hourly bars by event type; events that come later than ``late`` are left out."""
    ticks = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return ticks.groupBy(F.window("at", "1 hour").alias("w"), F.col("event_type").alias("symbol")).agg(
        F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.count("*").alias("trades")
    ).select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "trades")


class _OpenSignal(StatefulProcessor):
    """One user's position.  Ticks wait until the watermark has passed them, so they are taken in event order however they came."""

    def __init__(self, stop: float, target: float, keep_ms: int, grain_ms: int) -> None:
        self.stop, self.target, self.keep, self.grain = stop, target, keep_ms, grain_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "entry double, done boolean, seen bigint")
        self.waiting = handle.getMapState("waiting", "ms bigint, event_id bigint", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for b in rows:
            for ms, event_id, value in zip(b["ms"].tolist(), b["event_id"].tolist(), b["value"].tolist(), strict=True):
                self.waiting.updateValue((ms, event_id), (value,))
                due.add(-(-ms // self.grain) * self.grain)
        for ms in due:
            self.handle.registerTimer(ms)
        yield self._rows(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((k[0], k[1], v[0]) for k, v in self.waiting.iterator() if k[0] <= now)
        entry, done, seen = self.position.get() if self.position.exists() else (None, False, None)
        out = []
        for ms, event_id, value in due:
            self.waiting.removeKey((ms, event_id))
            seen = ms
            if entry is None:
                entry = value
            elif not done and (value <= entry * self.stop or value >= entry * self.target):
                out.append((event_id, "hit_sl" if value <= entry * self.stop else "hit_tp"))
                done = True
        if due:
            self.position.update((entry, done, seen))
            self.handle.registerTimer(seen + self.keep)
        elif seen is not None and now >= seen + self.keep:
            self.position.clear()  # quiet for long: the next tick opens a new position
        yield self._rows(key, out)

    def close(self) -> None:
        pass

    @staticmethod
    def _rows(key, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"user_id": pd.Series([key[0]] * len(out), dtype="int64"), "event_id": pd.Series([x[0] for x in out], dtype="int64"), "outcome": pd.Series([x[1] for x in out], dtype="object")})


def open_signals(ticks: DataFrame, stop: float, target: float, late: str = "1 hour", keep_ms: int = 7 * 86_400_000, grain_ms: int = 1000) -> DataFrame:
    """X-02: per user a long position from the first tick on, closed at the first tick at or beyond its stop or target.

    ``stop`` and ``target`` are shares of the entry.  First means by event time (then id): ticks are held back
    until none earlier can come, ``late`` behind the latest; ones that come later still are left out.  A user
    without a tick for ``keep_ms`` is forgotten, open or closed.  Timers fall on whole ``grain_ms``.
    """
    spark = ticks.sparkSession
    if spark.conf.get(STORE[0], "").rsplit(".", 1)[-1] != "RocksDBStateStoreProvider":
        spark.conf.set(*STORE)  # timers and map states need it
    timed = ticks.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    slim = timed.select("user_id", "event_id", "value", "at", F.unix_millis("at").alias("ms"))
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_id", T.LongType()), T.StructField("outcome", T.StringType())])
    return slim.groupBy("user_id").transformWithStateInPandas(_OpenSignal(stop, target, keep_ms, grain_ms), schema, "append", "eventTime")


def _best(rows: DataFrame) -> DataFrame:
    return rows.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("r")).select("user_id", "r.*")


def _whole(spark: SparkSession, folder: str) -> dict[int, str]:
    """The parts of a table that were written whole, by number."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return {int(n.split("=")[1]): f"{folder}/{n}" for n in names if "=" in n and fs.exists(jvm.org.apache.hadoop.fs.Path(at, f"{n}/_SUCCESS"))}


def _forget(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def _parts(spark: SparkSession, path: str, upto: int | None = None) -> list[str]:
    """The newest folded part and the changes since (up to a batch)."""
    folded, changed = _whole(spark, f"{path}/folded"), _whole(spark, f"{path}/changed")
    base = max((n for n in folded if upto is None or n <= upto), default=None)
    later = [p for n, p in sorted(changed.items()) if (base is None or n > base) and (upto is None or n <= upto)]
    return ([] if base is None else [folded[base]]) + later


def latest_reviews(reviews: DataFrame, path: str, checkpoint: str, fold_every: int = 16) -> DataStreamWriter:
    """X-03: keep the latest review of each user in a table that ``read_latest`` reads.

    A batch writes a row for each user that it touches and reads nothing; every ``fold_every`` batches the
    changes are folded into one part.  A repeated batch overwrites its own change; a part counts once it is whole.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        _best(batch.select("user_id", "ts", "event_id", "event_type")).write.mode("overwrite").parquet(f"{path}/changed/batch={number}")
        if (number + 1) % fold_every == 0:
            old = _parts(spark, path, number)
            _best(_read(spark, old)).write.mode("overwrite").parquet(f"{path}/folded/upto={number}")
            _forget(spark, old)

    return reviews.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def _read(spark: SparkSession, parts: list[str]) -> DataFrame:
    return spark.read.schema("user_id bigint, ts timestamp_ntz, event_id bigint, event_type string").parquet(*parts)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The latest review of each user: of the folded part and the changes since the greatest."""
    return _best(_read(spark, _parts(spark, path)))
