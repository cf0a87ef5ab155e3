"""Structured Streaming forms of the stateful behaviour: windows, sessions, repeats, rate limits, and incremental index upkeep.

Event time needs TIMESTAMP columns; `event_time` casts TIMESTAMP_NTZ under the session's UTC zone."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as T
from ..sources.shared import scratch, written

LATE = "10 minutes"


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def read_events(spark: SparkSession, path: str, schema) -> DataFrame:
    return event_time(spark.readStream.schema(schema).parquet(path))


def samples(events: DataFrame, every: str = "5 seconds", late: str = LATE) -> DataFrame:
    """Peak and count of tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w")).agg(F.max("value").alias("peak"), F.count(F.lit(1)).alias("n")).select("w.start", "peak", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def misses(events: DataFrame, key: str = "event_type", late: str = "5 minutes") -> DataFrame:
    """The first of each query key within five minutes of event time."""
    return events.withColumn("key", T.query_key(F.col(key))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["key"])


def accepted(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Sliding limiter: a call passes if fewer than `most` passed in the last `seconds`. Gives flags and the times held."""
    out = []
    for t in times:
        held = [h for h in held if t - h < seconds]
        ok = len(held) < most
        if ok:
            held.append(t)
        out.append(ok)
    return out, held


def rate_limited(events: DataFrame, most: int = 100, seconds: float = 60.0) -> DataFrame:
    """Batch form: event_id, accepted, for each user in time order. Whether a call passes depends on those before it, so a
    user's calls are one sequence; they are streamed in order, and only the last `most` accepted times are held."""
    ordered = events.select("event_id", "user_id", F.col("ts").cast("timestamp").cast("double").alias("t")).repartition("user_id").sortWithinPartitions("user_id", "t", "event_id")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, held = None, []
        for pdf in parts:
            flags = []
            for u, t in zip(pdf["user_id"], pdf["t"], strict=True):
                if u != user:
                    user, held = u, []
                ok, held = accepted([t], held, most, seconds)
                flags += ok
            yield pd.DataFrame({"event_id": pdf["event_id"], "accepted": flags})

    return ordered.mapInPandas(run, "event_id long, accepted boolean")


def rate_limited_stream(events: DataFrame, most: int = 100, seconds: float = 60.0) -> DataFrame:
    """Streaming form: the times held for each user are its state, dropped when they are too old."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(parts)).sort_values(["t", "event_id"])
        flags, held = accepted(pdf["t"].tolist(), held, most, seconds)
        state.update((held,))
        if held:
            state.setTimeoutTimestamp(int(max(held[-1] * 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1)))
        yield pd.DataFrame({"event_id": pdf["event_id"], "accepted": flags})

    rows = events.withWatermark("ts", LATE).withColumn("t", F.col("ts").cast("double"))
    return rows.groupBy("user_id").applyInPandasWithState(run, "event_id long, accepted boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def maintain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Applies each micro-batch of changed files to an index; the checkpoint makes repeats visible by batch id."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


# ---- runs that end by themselves, restarts, and the exact repeat cache

#: The state store that keyed timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

class Replay:
    """A table as a stream of files in event order, one micro-batch each."""

    def __init__(self, events: DataFrame, files: int = 4, order: str = "ts"):
        self.schema, self.spark, self.path, self.next = events.schema, events.sparkSession, scratch(events.sparkSession, "replay"), 1
        at = F.col(order).cast("double")
        bounds = events.select(at.alias("t")).approxQuantile("t", [i / files for i in range(1, files)], 0.0) if files > 1 else []
        self.files, self.parts = files, written(events.withColumn("_part", sum([F.when(at > b, 1).otherwise(0) for b in bounds], F.lit(1))), "replay-parts")

    def add(self, n: int) -> Replay:
        """The next n files come in, one after the other: the source takes files by their time."""
        for i in range(self.next, min(self.files, self.next + n - 1) + 1):
            self.parts.where(F.col("_part") == i).drop("_part").coalesce(1).write.mode("append").parquet(self.path)
        self.next += n
        return self

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.path)


def replayed(events: DataFrame, files: int = 4, order: str = "ts") -> DataFrame:
    return Replay(events, files, order).add(files).stream()


def finished(stream: DataFrame, what: str, checkpoint: str | None = None) -> DataFrame:
    """Runs an append stream over all that is there and gives its rows as a table."""
    spark = stream.sparkSession
    path, own = scratch(spark, what), spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint or scratch(spark, f"{what}-checkpoint")).trigger(availableNow=True).start(path)
        query.awaitTermination()
    finally:
        spark.conf.set(STORE[0], own) if own else spark.conf.unset(STORE[0])
    return spark.read.schema(stream.schema).parquet(path)


def _repeats(seconds: float) -> StatefulProcessor:
    # Inside a function, so that it is sent by value: the worker that sets up the state may not have this package.
    class Repeats(StatefulProcessor):
        """The time a key was last seen; a row is a hit if that is less than `seconds` before it. A timer forgets keys that no
        row can hit any more."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.last = handle.getValueState("last", "t double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            last = self.last.get()[0] if self.last.exists() else float("-inf")
            pdf = pd.concat(list(rows)).sort_values(["t", "event_id"])
            times = pdf["t"].to_numpy()
            before = [last, *times[:-1]]
            self.last.update((float(max(times[-1], last)),))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((max(times[-1], last) + seconds) * 1000) + 1)
            yield pd.DataFrame({"event_id": pdf["event_id"], "key": key[0], "hit": [0 <= t - b < seconds for t, b in zip(times, before, strict=True)]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.last.clear()
            return iter(())

        def close(self) -> None:
            pass

    return Repeats()


def cache_hits(events: DataFrame, key: str = "query", seconds: float = 300.0, late: str = LATE) -> DataFrame:
    """event_id, key, hit of each row of a stream whose micro-batches come in event order: whether its normal form was seen
    less than `seconds` before. Any occurrence refreshes. What is later than the watermark is not seen. A key's rows of one
    micro-batch are one group, so the source should bound a micro-batch (files or offsets a trigger)."""
    rows = events.withColumn("key", T.query_key(F.col(key))).withWatermark("ts", late).select("ts", "event_id", "key", F.col("ts").cast("double").alias("t"))
    return rows.groupBy("key").transformWithStateInPandas(_repeats(seconds), "event_id long, key string, hit boolean", "append", "EventTime")


def sliding(events: DataFrame, length: str = "2 hours", step: str = "1 hour", late: str = LATE) -> DataFrame:
    """start, event_type, n, peak of sliding windows that are closed: their end is not after the watermark."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select("w.start", "event_type", "n", "peak")


class Ledger:
    """Micro-batches that are applied once, though a restart may repeat one. A batch's rows are written first, the line that
    names them after; rows without a line are never read, and a batch that has a line is left alone."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.checkpoint = f"{self.root}/checkpoint"

    def lines(self) -> list[tuple[int, str]]:
        """(batch, path) of what is applied, in order of the batches."""
        try:
            rows = self.spark.read.schema("batch long, path string").parquet(f"{self.root}/ledger").collect()
        except AnalysisException:  # nothing is applied yet
            return []
        return sorted((r.batch, r.path) for r in rows)

    def apply(self, df: DataFrame, batch: int) -> bool:
        """Whether the batch was new."""
        if any(batch == b for b, _ in self.lines()):
            return False
        path = f"{self.root}/rows/{batch}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.spark.createDataFrame([(batch, path)], "batch long, path string").coalesce(1).write.mode("append").parquet(f"{self.root}/ledger")
        return True

    def table(self, schema) -> DataFrame:
        paths = [p for _, p in self.lines()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def run(self, stream: DataFrame, change: Callable[[DataFrame], DataFrame] = lambda df: df, checkpoint: str | None = None) -> None:
        """Applies all that is there, or what an earlier run left, and ends."""
        done = lambda df, batch: self.apply(change(df), batch) and None
        stream.writeStream.foreachBatch(done).option("checkpointLocation", checkpoint or self.checkpoint).trigger(availableNow=True).start().awaitTermination()

    def unnoted(self, batch: int) -> None:
        """Takes back the checkpoint's note that a batch is done, as if the driver had been lost just before it: the next run
        repeats the batch."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        note = jvm.org.apache.hadoop.fs.Path(f"{self.checkpoint}/commits/{batch}")
        note.getFileSystem(conf).delete(note, False)
