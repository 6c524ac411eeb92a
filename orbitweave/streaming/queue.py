"""The observation queue as a stream: the same views as the batch operator, from keyed state.

Events are ``key, t_us, event_id, kind`` (``detection`` or ``opportunity``) with an event-time column. They are
keyed by time bucket of the time to live and by a share of the targets, and each stands in its own bucket and,
as what came before, in the next one: a view's detection is never further back. So however many events a target
has, a state holds two buckets of it. Calls and timers are counted by states: many targets in one share
are one call, and a stream of more events takes more shares.

A state has a list of the events that the watermark has not passed, to which batches only append, a block of
them at a time, and a block of the detections that wait. An event-time timer at the earliest event makes events
final: they are taken in order of time, detections first. The last timer, when the bucket has ended, clears
the state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

VIEWS = "key string, event_id long, seen_us long, detected_us long"
#: Ids are texts on the way: a null id would make the numbers of a whole batch floating.
_SEEN = "key string, event_id string, seen_us long, detected_us long"
#: Rows of events or of waiting detections, as Arrow.
_BLOCK = "rows binary"
_EVENT = pa.schema([("key", pa.string()), ("t_us", pa.int64()), ("event_id", pa.string()), ("detection", pa.bool_())])
_WAITING = pa.schema([("key", pa.string()), ("detected_us", pa.int64()), ("viewed_us", pa.int64())])
#: Shares of the targets, and so states of a bucket; a stream goes on with the number it began with.
SHARES = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def advance(final: pd.DataFrame, waiting: pd.DataFrame, delay_us: int, ttl_us: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Takes final events of many targets in order; returns each target's waiting detection and when it was viewed, and the views."""
    before = waiting.rename(columns={"detected_us": "t_us"}).assign(detection=True, event_id=None)
    rows = pd.concat([before, final.assign(viewed_us=pd.array([pd.NA] * len(final), "Int64"))], ignore_index=True).astype({"t_us": "int64", "detection": bool, "viewed_us": "Int64"})
    rows["target"] = pd.factorize(rows.key, use_na_sentinel=False)[0]
    rows = rows.sort_values(["target", "t_us", "detection"], ascending=[True, True, False], kind="stable", ignore_index=True)
    rows["detected_us"] = rows.t_us.where(rows.detection).astype("Int64").groupby(rows.target).ffill()
    waited = rows.t_us - rows.detected_us
    fit = (~rows.detection & (waited > delay_us) & (waited <= ttl_us)).fillna(False).astype(bool)
    # A detection is seen at its first time that fits, by all that come at that time; one that was seen before keeps its time.
    rows["viewed_us"] = rows.viewed_us.fillna(rows.t_us.where(fit).astype("Int64"))
    rows["viewed_us"] = rows.groupby(["target", "detected_us"], dropna=False).viewed_us.transform("min")
    seen = rows[fit & (rows.t_us == rows.viewed_us).fillna(False).astype(bool)]
    last = rows.drop_duplicates("target", keep="last")
    return last.loc[last.detected_us.notna(), ["key", "detected_us", "viewed_us"]], seen.rename(columns={"t_us": "seen_us"})[["key", "event_id", "seen_us", "detected_us"]]


def _block(rows: pd.DataFrame, schema: pa.Schema) -> tuple[bytes]:
    table = pa.Table.from_pandas(rows[schema.names], schema, preserve_index=False).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _rows(blocks: list[tuple[bytes]], schema: pa.Schema) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(b[0])).read_all() for b in blocks]
    kinds = {pa.int64(): pd.Int64Dtype()} if schema is _WAITING else {}
    return (pa.concat_tables(tables) if tables else schema.empty_table()).to_pandas(types_mapper=kinds.get)


class TargetQueue(StatefulProcessor):
    """A share of the targets in one time bucket: the events of the bucket before it are only what came before."""

    def __init__(self, delay_us: int, ttl_us: int):
        self.delay_us, self.ttl_us = delay_us, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", _BLOCK)
        self.waiting = handle.getValueState("waiting", _BLOCK)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = not self.pending.exists()
        first = None
        for frame in rows:
            if len(frame):
                first = int(frame.t_us.min()) if first is None else min(first, int(frame.t_us.min()))
                self.pending.appendValue(_block(frame, _EVENT))
        if new:
            self.handle.registerTimer(self._after(max(first, key[1] * self.ttl_us)))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until_us = timerValues.getCurrentWatermarkInMs() * 1000
        events = _rows(list(self.pending.get()), _EVENT)
        final, later = events[events.t_us < until_us], events[events.t_us >= until_us]
        before = _rows([self.waiting.get()] if self.waiting.exists() else [], _WAITING)
        waiting, views = advance(final, before, self.delay_us, self.ttl_us)
        start, end = key[1] * self.ttl_us, (key[1] + 1) * self.ttl_us
        if until_us >= end:
            self.pending.clear()
            self.waiting.clear()
        else:
            if len(waiting):
                self.waiting.update(_block(waiting, _WAITING))
            if len(later):
                self.pending.put([_block(later, _EVENT)])
            else:
                self.pending.clear()
            self.handle.registerTimer(self._after(int(later.t_us.min()) if len(later) else end))
        yield views[views.seen_us >= start].astype({"seen_us": "int64", "detected_us": "int64"})

    def close(self) -> None:
        pass

    @staticmethod
    def _after(t_us: int) -> int:
        """The first millisecond at which the watermark has passed a time."""
        return t_us // 1000 + 1


def stream_queue(events: DataFrame, ts: str, delay_s: int, ttl_s: int, late: str = "20 minutes", shares: int = SHARES) -> DataFrame:
    """Views of a stream with columns ``key, event_id, kind, t_us`` and the event time ``ts``; rows come at most ``late``.

    A row without a time is no event; an event of another kind than ``detection`` is an opportunity. ``shares`` is the number
    of states of a time bucket: it bounds the calls, and what a state holds is the events of two buckets divided by it."""
    delay_us, ttl_us = delay_s * 1_000_000, ttl_s * 1_000_000
    own = F.floor(F.col("t_us") / ttl_us)
    rows = events.withWatermark(ts, late).select(F.col("key").cast("string").alias("key"), F.col("t_us").cast("long"), F.col("event_id").cast("string"), F.col("kind").eqNullSafe("detection").alias("detection"), ts, F.explode(F.array(own, own + 1)).alias("bucket"))
    grouped = rows.where("t_us IS NOT NULL").withColumn("share", F.pmod(F.xxhash64("key"), F.lit(shares))).groupBy("share", "bucket")
    seen = grouped.transformWithStateInPandas(statefulProcessor=TargetQueue(delay_us, ttl_us), outputStructType=_SEEN, outputMode="Append", timeMode="EventTime")
    return seen.select("key", F.col("event_id").cast("long").alias("event_id"), "seen_us", "detected_us")


def write_queue(views: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run through all that has come so far, from where ``checkpoint`` stands, with state in RocksDB; views go to Parquet files, once each."""
    spark = views.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        query = views.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(name, before)
    return query


def write_slices(events: DataFrame, ts: str, t_us: str, path: str, slices: int, rows_per_file: int = 1_000_000) -> int:
    """Land a table in a folder that a stream reads, one slice of time after another, so that files are as old as their rows.

    A slice has a file for each ``rows_per_file`` of an even slice, however many tasks the table is read by: a stream takes
    so many files at once. The last file is a row without a key, a slice and a day after the others: it lets the
    watermark pass all of them. Returns the slices' length in seconds; rows of one slice come in any order, so
    they are at most so late."""
    first, last, n = events.agg(F.min(t_us), F.max(t_us), F.count("*")).first()
    if first is None:
        events.write.mode("append").parquet(path)
        return 1
    step = (last - first) // slices + 1
    files = -(-n // (slices * rows_per_file))
    for k in range(slices):
        events.where(F.col(t_us).between(first + k * step, first + (k + 1) * step - 1)).repartition(files).write.mode("append").parquet(path)
    seconds = step // 1_000_000 + 1
    far = last + (seconds + 2 * 86_400) * 1_000_000
    close = events.sparkSession.range(0, 1, 1, 1).select(*(F.timestamp_micros(F.lit(far)).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(far).cast(f.dataType).alias(f.name) if f.name == t_us else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema))
    close.write.mode("append").parquet(path)
    return seconds


def read_slices(spark: SparkSession, path: str, schema, files_per_batch: int) -> DataFrame:
    """The folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
