"""Streaming forms of the operators: capture ingest, live messages, alerts, counters.

Each job is a Structured Streaming query with its checkpoint beside its sink.
Re-delivery is harmless: batches write their own partition of an append-only
log, and the store is a view over that log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from turnloom.operators.ordering import first_wins

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str | None = None, fmt: str = "parquet", files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.load(directory)


def _log_batches(stream: DataFrame, path: str, checkpoint: str, prepare, trigger: dict[str, Any]) -> StreamingQuery:
    def write(batch: DataFrame, batch_id: int) -> None:
        # a batch that is run again overwrites its own folder and nothing else
        prepare(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(
    captures: DataFrame, check: Column, path: str, rejects: str, checkpoint: str, trigger: dict[str, Any] | None = None
) -> StreamingQuery:
    """Captured records into the store log; rows failing `check` (a code or null) go to `rejects` as codes."""

    def prepare(batch: DataFrame, batch_id: int) -> DataFrame:
        coded = batch.withColumn("code", check)
        coded.filter("code is not null").select("doc_id", "code").write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
        return coded.filter("code is null").drop("code")

    return _log_batches(captures, path, checkpoint, prepare, trigger or {"availableNow": True})


def store_view(spark: SparkSession, path: str) -> DataFrame:
    """Latest row per document with the earliest creation time, over the log."""
    log = spark.read.parquet(path)
    order = [F.col("updated_at").desc(), F.col("batch_id").desc()]
    latest = first_wins(log, ["doc_id"], order)
    born = log.groupBy("doc_id").agg(F.min("created_at").alias("__born"))
    return latest.join(born, "doc_id").withColumn("created_at", F.col("__born")).drop("__born", "batch_id")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The log rewritten as one store table; point the readers at `target` and start a new log."""
    store_view(spark, path).write.mode("overwrite").parquet(target)


def without_repeats(stream: DataFrame, key: str, ts: str, delay: str) -> DataFrame:
    """Exact repeats inside the delay are dropped with bounded state."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def latest_snapshots(snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """The last snapshot of each key. In update mode a trigger writes the keys that it has changed."""
    fields = [c for c in snapshots.columns if c != key]
    return snapshots.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("s")).select(key, "s.*")


def running_counters(relays: DataFrame, key: str, amount: str, ts: str) -> DataFrame:
    """Totals and last time per key (update or complete mode)."""
    return relays.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.sum(amount).alias("amount"), F.max(ts).alias("last_at")
    )


def daily(events: DataFrame, ts: str, delay: str = "1 day") -> DataFrame:
    """Tumbling daily counts. In append mode a day is written once, when the watermark has passed it, and leaves the state."""
    return events.withWatermark(ts, delay).groupBy(F.window(ts, "1 day")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").cast("date").alias("day"), "n"
    )


def sessions(events: DataFrame, key: str, ts: str, gap: str, delay: str = "1 day") -> DataFrame:
    """Event sessions per key by inactivity gap. In append mode a session is written, and forgotten, when the watermark has passed its end."""
    return events.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n"
    )


class _InOrder(StatefulProcessor):
    """Rows of a key wait in list state until the watermark has passed them and are then released by time.

    Rows that may still come are later than the watermark, so a release is final: the
    order is that of the event times, whatever files or batches the rows came in. One
    timer per key stands at its earliest waiting row (or at the time its memory may be
    forgotten), so a key is visited once per watermark that concerns it. What waits is
    bounded by the delay. Rows are kept packed, one state value per arriving batch.
    Spark's first watermark is 1970: rows not later than that are dropped as late.
    """

    memory: str  # schema of what a key remembers between releases

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.kept = handle.getValueState("kept", self.memory)
        self.due = handle.getValueState("due", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            batch = batch.drop(columns="at")
            if len(batch):
                self.waiting.appendValue((pa.ipc.serialize_pandas(batch, preserve_index=False).to_pybytes(),))
                low = int(batch["us"].min())
                first = low if first is None else min(first, low)
        if first is not None:
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        packed = [pa.ipc.open_stream(r[0]).read_pandas() for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat(packed, ignore_index=True) if packed else None
        memory = self.kept.get() if self.kept.exists() else None
        later = None
        if rows is not None:
            ready = (rows["us"] <= passed).to_numpy()
            if ready.any():
                out, memory = self.release(rows[ready], memory)
                self.kept.update(memory)
                yield out
                self.waiting.clear()
                if not ready.all():
                    self.waiting.put([(pa.ipc.serialize_pandas(rows[~ready], preserve_index=False).to_pybytes(),)])
            later = int(rows["us"][~ready].min()) if not ready.all() else None
        until = self.forget_at(memory) if memory is not None else None
        if until is not None and until <= passed:
            self.kept.clear()
            until = None
        wanted = [t for t in (later, until) if t is not None]
        if wanted:
            self._wake(min(wanted))

    def _wake(self, us: int) -> None:
        ms = us // 1000 + 1
        if self.due.exists():
            if self.due.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.due.get()[0])
        self.handle.registerTimer(ms)
        self.due.update((ms,))

    def release(self, rows: pd.DataFrame, memory: tuple | None) -> tuple[pd.DataFrame, tuple]:
        """The output for rows whose time has come, and what is remembered."""
        raise NotImplementedError

    def forget_at(self, memory: tuple) -> int | None:
        """The time (us) from which the memory makes no difference, or may be dropped."""
        return None

    def close(self) -> None:
        pass


class _Debouncer(_InOrder):
    """Remembers the time of the key's last emitted event, until the window behind it is over."""

    memory = "us long"

    def __init__(self, window_us: int):
        self.window_us = window_us

    def release(self, rows: pd.DataFrame, memory: tuple | None) -> tuple[pd.DataFrame, tuple]:
        rows = rows.sort_values(["us", "event_id"], kind="stable").drop_duplicates("us")
        us, hits = rows["us"].to_numpy(), []
        at = 0 if memory is None else int(np.searchsorted(us, memory[0] + self.window_us))
        while at < len(us):  # one step per emitted event
            hits.append(at)
            at = int(np.searchsorted(us, us[at] + self.window_us))
        last = int(us[hits[-1]]) if hits else memory[0]
        return rows.iloc[hits][["key", "event_id"]], (last,)

    def forget_at(self, memory: tuple) -> int:
        return memory[0] + self.window_us


def debounced_alerts(events: DataFrame, key: str, ts: str, event_id: str, seconds: int, delay: str = "1 hour") -> DataFrame:
    """Alerts at least `seconds` after the last emitted one of their key, by event time; of equal times the least id.

    Events later than `delay` behind the newest are dropped (Spark's watermark).
    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
    """
    rows = events.withWatermark(ts, delay).select(
        F.col(key).cast("string").alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.unix_micros(ts).alias("us"), F.col(ts).alias("at")
    )
    return rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Debouncer(seconds * 1_000_000), outputStructType="key string, event_id long", outputMode="Append", timeMode="EventTime"
    )


class _Appender(_InOrder):
    """Remembers the index of the next message of a conversation."""

    memory = "idx long, us long"

    def __init__(self, idle_us: int | None):
        self.idle_us = idle_us

    def release(self, rows: pd.DataFrame, memory: tuple | None) -> tuple[pd.DataFrame, tuple]:
        at = memory[0] if memory else 0
        rows = rows.sort_values(["us", "position"], kind="stable")
        out = pd.DataFrame({"conv_id": rows["conv_id"], "idx": range(at, at + len(rows)), "role": rows["role"], "content": rows["content"]})
        return out, (at + len(rows), int(rows["us"].iloc[-1]))

    def forget_at(self, memory: tuple) -> int | None:
        return None if self.idle_us is None else memory[1] + self.idle_us


def append_messages(deltas: DataFrame, ts: str, delay: str = "1 hour", idle_seconds: int | None = None) -> DataFrame:
    """Live messages (conv_id, position, role, content and their time) as turns with the next index of their chat.

    Messages are ordered by time, then position, over all files and batches. With
    `idle_seconds`, a chat without a message for so long leaves the state; one that
    goes on after that starts at 0 again.
    """
    rows = deltas.withWatermark(ts, delay).select("conv_id", "position", "role", "content", F.unix_micros(ts).alias("us"), F.col(ts).alias("at"))
    return rows.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=_Appender(None if idle_seconds is None else idle_seconds * 1_000_000),
        outputStructType="conv_id string, idx long, role string, content string",
        outputMode="Append",
        timeMode="EventTime",
    )


END = "2262-01-01 00:00:00"  # the time of the mark that ends a bounded stream; pandas knows none after that year


def run_in_order(stream: DataFrame, ts: str, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, marks: str) -> DataFrame:
    """Run `build(stream)`, which waits for a watermark, to the end of a bounded stream and read the result back.

    The stream is joined by a folder of end marks, empty at first. When the rows are
    through, one row of that time is put there and the query goes on from its
    checkpoint: the watermark passes every row, and all that waits is released.
    """
    spark = stream.sparkSession
    mark = spark.range(1).select(
        *[(F.lit(END).cast("timestamp") if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name) for f in stream.schema.fields]
    )
    mark.limit(0).write.mode("overwrite").parquet(marks)
    ended = spark.readStream.schema(stream.schema).parquet(marks)
    run_to_table(build(stream.unionByName(ended)), path, checkpoint)
    mark.write.mode("append").parquet(marks)
    return run_to_table(build(stream.unionByName(ended)), path, checkpoint)


def flush_index(stream: DataFrame, path: str, checkpoint: str, build, every: str = "5 seconds", once: bool = False) -> StreamingQuery:
    """Search postings of new turns appended at a fixed pace; `build(batch)` gives the postings."""
    trigger = {"availableNow": True} if once else {"processingTime": every}
    return _log_batches(stream, path, checkpoint, lambda batch, _: build(batch), trigger)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a bounded stream to its end and read the result back."""
    spark = stream.sparkSession
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(path)
    if mode == "complete":
        newest = log.agg(F.max("batch_id")).first()[0]
        return log.filter(F.col("batch_id") == newest).drop("batch_id")
    return log


