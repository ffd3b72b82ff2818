"""Request metrics, objectives and held alerts on a stream of requests; storage events into a register.

Frames may be streams or tables: the same functions run on both. Event time is the column `ts` (a timestamp).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.window import Window

from ..sources.tables import append_unseen, scratch

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"

#: Upper bounds of the latency buckets in seconds; the last is open.
BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def with_event_time(df: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """ts as a timestamp with a watermark (which a stream needs, and which rejects timestamps without zone)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def request_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("method", "route", "status").agg(F.count("*").alias("requests"))


def latency_histogram(df: DataFrame, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Cumulative counts by upper bound (null: all)."""
    le = F.explode(F.concat(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col("seconds") <= b), F.array(F.lit(float("inf")))))
    return df.select("method", "route", le.alias("le")).groupBy("method", "route", "le").agg(F.count("*").alias("n"))


def slo_windows(df: DataFrame, size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Per window: requests, the share of 5xx (the count of requests taken as at least 1e-6), and requests a second."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    errors = F.count_if(F.col("status").between(500, 599))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    grouped = df.groupBy(w.alias("w")).agg(F.count("*").alias("requests"), errors.alias("errors"))
    return grouped.select(F.col("w.start").alias("start"), "requests", (F.col("errors") / F.greatest(F.col("requests").cast("double"), F.lit(1e-6))).alias("error_ratio"), (F.col("requests") / seconds).alias("rate"))


def _bucket_counts(bounds: Sequence[float]) -> list[Column]:
    return [F.count_if(F.col("seconds") <= b).alias(f"b{i}") for i, b in enumerate(bounds)]


def _from_buckets(q: float, bounds: Sequence[float]) -> Column:
    """The quantile read off counts n and b0, b1, ..., linear within a bucket; past the last bound, that bound."""
    target = F.col("n") * q
    value: Column = F.lit(float(bounds[-1]))
    for i in reversed(range(len(bounds))):
        below, low = (F.col(f"b{i - 1}") if i else F.lit(0)), (bounds[i - 1] if i else 0.0)
        inside = F.lit(low) + (F.lit(bounds[i]) - F.lit(low)) * F.coalesce(F.try_divide(target - below, (F.col(f"b{i}") - below).cast("double")), F.lit(1.0))
        value = F.when(F.col(f"b{i}") >= target, inside).otherwise(value)
    return value


def latency_quantile(df: DataFrame, q: float = 0.95, size: str = "5 minutes", slide: str | None = None, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Per window the quantile read off bucket counts."""
    g = df.groupBy((F.window("ts", size, slide) if slide else F.window("ts", size)).alias("w")).agg(F.count("*").alias("n"), *_bucket_counts(bounds))
    return g.select(F.col("w.start").alias("start"), _from_buckets(q, bounds).alias("quantile"))


def request_board(df: DataFrame, q: float = 0.95, size: str = "1 minute", bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Per window, from one aggregation: requests a second, the share of 5xx and the latency quantile."""
    g = df.groupBy(F.window("ts", size).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("status").between(500, 599)).alias("errors"), *_bucket_counts(bounds))
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    return g.select(F.col("w.start").alias("start"), (F.col("n") / seconds).alias("rate"), (F.col("errors") / F.greatest(F.col("n").cast("double"), F.lit(1e-6))).alias("error_ratio"), _from_buckets(q, bounds).alias("quantile"))


def held_alert(samples: DataFrame, key: str, ts: str, condition: Column, hold_seconds: int = 120) -> DataFrame:
    """Table form: each sample with its state. A condition that holds is pending, and firing once it has held for hold_seconds; else inactive."""
    w = Window.partitionBy(key).orderBy(ts)
    on = F.coalesce(condition, F.lit(False))
    runs = samples.withColumn("_on", on).withColumn("_run", F.sum(F.when(F.col("_on") & ~F.coalesce(F.lag("_on").over(w), F.lit(False)), 1).otherwise(0)).over(w))
    since = F.min(F.when(F.col("_on"), F.col(ts))).over(Window.partitionBy(key, "_run"))
    held = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(since.cast("timestamp")) >= hold_seconds * 1_000_000
    return runs.withColumn("state", F.when(~F.col("_on"), "inactive").when(held, "firing").otherwise("pending")).drop("_on", "_run")


def alert_transitions(states: DataFrame, key: str, ts: str) -> DataFrame:
    """Rows (key, ts, change): firing when an alert begins to fire, resolved when it stops."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(key).orderBy(ts)), F.lit("inactive"))
    change = F.when((F.col("state") == "firing") & (before != "firing"), "firing").when((F.col("state") != "firing") & (before == "firing"), "resolved")
    return states.withColumn("change", change).filter("change IS NOT NULL").select(key, ts, "change")


class AlertProcessor(StatefulProcessor):
    """The state of one key: samples that wait for the watermark (appended, never rewritten as they come; those of a batch packed as one entry), the start of its run and whether it fires."""

    def __init__(self, key: str, hold_seconds: int) -> None:
        self.key, self.hold = key, hold_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at binary, state binary")
        self.run = handle.getValueState("run", "since long, fires boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = [(f["ts"].to_numpy(dtype="datetime64[us]").astype(np.int64), f["on"].eq(True).to_numpy(dtype=bool)) for f in rows]
        at, on = (np.concatenate(c) for c in zip(*frames, strict=True))
        later = at > passed
        if later.any():
            self.waiting.appendValue((at[later].tobytes(), on[later].tobytes()))
            self.handle.registerTimer(-(-int(at[later].min()) // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packed = list(self.waiting.get())
        if not packed:
            return
        at, on_ = np.frombuffer(b"".join(p[0] for p in packed), np.int64), np.frombuffer(b"".join(p[1] for p in packed), bool)
        order = np.argsort(at, kind="stable")
        at, on_ = at[order], on_[order]
        n = int(np.searchsorted(at, passed, side="right"))
        due = list(zip(at[:n].tolist(), on_[:n].tolist(), strict=True))
        if not due:
            return
        since, fires = self.run.get() if self.run.exists() else (None, False)
        out = []
        for now, on in due:
            if on:
                since = now if since is None else since
                if not fires and now - since >= self.hold:
                    fires = True
                    out.append((key[0], pd.Timestamp(now, unit="us"), "firing"))
            else:
                if fires:
                    out.append((key[0], pd.Timestamp(now, unit="us"), "resolved"))
                since, fires = None, False
        if since is None:
            self.run.clear()
        else:
            self.run.update((since, fires))
        if n < len(at):
            self.waiting.put([(at[n:].tobytes(), on_[n:].tobytes())])
            self.handle.registerTimer(-(-int(at[n]) // 1000))
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "ts", "change"])

    def close(self) -> None:
        pass


def alert_stream(samples: DataFrame, key: str, hold_seconds: int = 120) -> DataFrame:
    """Stream form of held_alert and alert_transitions: samples (key, ts, on) with a watermark on ts -> (key, ts, change), each change once.

    Samples wait in a list of the state until a timer says that the watermark has passed them and are then worked through in order of ts, so batches may cut and mix them as
    they like; a sample that comes after that is left out, as from windows. A key that is quiet and has nothing waiting has no state and no timer.
    The query must be started with the RocksDB state store, as run_to_end does.
    """
    kind = samples.schema[key].dataType.simpleString()
    return samples.groupBy(key).transformWithStateInPandas(AlertProcessor(key, hold_seconds), f"{key} {kind}, ts timestamp, change string", "Append", "EventTime")


def storage_status(df: DataFrame, bucket: str, existing: DataFrame, wanted: str = "OBJECT_FINALIZE") -> DataFrame:
    """Each event with its status: error (a field is missing), ignored (another type or bucket), error (no such object), registered."""
    known = existing.select(F.col("object_name"), F.lit(True).alias("_there")).distinct()
    both = df.join(known, "object_name", "left")
    lacking = F.col("bucket").isNull() | F.col("object_name").isNull() | F.col("event_type").isNull()
    status = F.when(lacking, "error:missing_field").when(F.col("event_type") != wanted, "ignored:event_type").when(F.col("bucket") != bucket, "ignored:bucket").when(F.col("_there").isNull(), "error:object_not_found").otherwise("registered")
    return both.withColumn("status", status).drop("_there")


def register(path: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch: appends registered objects that the table at path does not hold yet, so a batch may come twice."""

    def write(batch: DataFrame, _: int) -> None:
        append_unseen(batch.sparkSession, path, batch.filter("status = 'registered'").select("object_name").distinct(), ["object_name"])

    return write


def ordered_events(arrivals: DataFrame, pickups: DataFrame, days: DataFrame) -> DataFrame:
    """Arrivals, pickups and day ends as one log with (minute, priority): what arrives at a minute comes before what is taken."""
    a = arrivals.select("day", "bin", "minute", F.lit(0).alias("priority"), "kg")
    p = pickups.select("day", "bin", "minute", F.lit(1).alias("priority"), "kg")
    e = days.select("day", F.lit(None).cast("int").alias("bin"), F.lit(1440).alias("minute"), F.lit(2).alias("priority"), F.lit(0).cast("long").alias("kg"))
    return a.unionByName(p).unionByName(e)


def daily_totals(df: DataFrame) -> DataFrame:
    return df.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors")).select(F.col("w.start").alias("start"), "requests", "errors")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Work through all that is there now and give the result table: of complete mode (counters, whose state is the table itself) the last batch, of
    append mode all batches: of windows those that the watermark has closed, whose state is freed."""
    spark = stream.sparkSession
    out, seen = scratch(spark, "stream"), []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)

    provider, rocks = spark.conf.get(STATE_STORE), "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set(STATE_STORE, rocks)  # what a query starts with stays with it
    try:
        query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "stream-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE, provider)
    if not seen:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{out}/batch={n}" for n in (seen[-1:] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(stream.schema).parquet(*paths)
