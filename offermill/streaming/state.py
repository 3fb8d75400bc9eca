"""Streams of requests and events: cool-downs, budgets, caches and windows, by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import BUDGET_PER_MINUTE, COOLDOWN_CAP_MS


def event_stream(spark: SparkSession, folder: str, files: int = 1, pattern: str = "events.parquet") -> DataFrame:
    """The events table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


class CoolDown(StatefulProcessor):
    """Rows (key, at_ms, failed, base_ms) with the run of failures and until when the key cools down."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("run", "run long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        run, until = map(int, self.state.get()) if self.state.exists() else (0, 0)
        out = []
        for r in pd.concat(rows).sort_values(["at_ms", "seq"]).itertuples():
            allowed = r.at_ms >= until
            if r.failed:
                run += 1
                until = r.at_ms + min(r.base_ms * 2 ** min(run - 1, 40), COOLDOWN_CAP_MS)
            else:
                run = 0
            out.append((key[0], r.seq, run, until, allowed))
        self.state.update((run, until))
        yield pd.DataFrame(out, columns=["key", "seq", "run", "until_ms", "allowed"])

    def close(self) -> None:
        pass


class Budget(StatefulProcessor):
    """Rows (key, seq, at_ms) with how many requests the key made in the last minute, and whether one more is allowed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        times = sorted(int(t[0]) for t in self.times.get()) if self.times.exists() else []
        out = []
        for r in pd.concat(rows).sort_values(["at_ms", "seq"]).itertuples():
            times = [t for t in times if r.at_ms - t < 60_000]
            allowed = len(times) < BUDGET_PER_MINUTE
            out.append((key[0], r.seq, len(times), allowed))
            if allowed:
                times.append(int(r.at_ms))
        self.times.put([(t,) for t in times])
        yield pd.DataFrame(out, columns=["key", "seq", "recent", "allowed"])

    def close(self) -> None:
        pass


class Cache(StatefulProcessor):
    """Rows (key, seq, entry, at_ms) of caches: a hit if the entry is at most ttl_ms old; of a full cache the oldest entry goes."""

    ttl_ms, most = 30 * 60_000, 100

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "entry string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        held = {k[0]: int(v[0]) for k, v in self.entries.iterator()}
        before, out = set(held), []
        for r in pd.concat(rows).sort_values(["at_ms", "seq"]).itertuples():
            hit = r.entry in held and r.at_ms - held[r.entry] <= self.ttl_ms
            if not hit:
                if len(held) >= self.most:
                    del held[min(held, key=lambda k: (held[k], k))]
                held[r.entry] = int(r.at_ms)
            out.append((key[0], r.seq, hit))
        for k in before - set(held):
            self.entries.removeKey((k,))
        for k, v in held.items():
            self.entries.updateValue((k,), (v,))
        yield pd.DataFrame(out, columns=["key", "seq", "hit"])

    def close(self) -> None:
        pass


class PageCache(Cache):
    ttl_ms, most = 60 * 60_000, 500


def cache_key(query, category, countries, depth):
    return F.concat_ws(":", F.lower(F.trim(query)), category, F.array_join(F.array_sort(countries), ","), depth)


def _stateful(df: DataFrame, processor: StatefulProcessor, schema: str) -> DataFrame:
    return df.groupBy("key").transformWithStateInPandas(processor, schema, "append", "none")


def cooled_down(requests: DataFrame) -> DataFrame:
    return _stateful(requests, CoolDown(), "key string, seq long, run long, until_ms long, allowed boolean")


def budgeted(requests: DataFrame) -> DataFrame:
    return _stateful(requests, Budget(), "key string, seq long, recent long, allowed boolean")


def cached(requests: DataFrame, processor: Cache | None = None) -> DataFrame:
    return _stateful(requests, processor or Cache(), "key string, seq long, hit boolean")


def tumbling(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type; windows close when the watermark passes them."""
    windows = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return windows.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def fresh(events: DataFrame, keys: list[str], ttl: str = "30 minutes") -> DataFrame:
    """The first event of each key within a time: what a cache of that age would miss."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def run_now(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through a table in memory; for small results and tests."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def run_to(df: DataFrame, folder: str, checkpoint: str) -> None:
    """All that a stream has now, appended to a Parquet table exactly once."""
    df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", folder).trigger(availableNow=True).start().awaitTermination()
