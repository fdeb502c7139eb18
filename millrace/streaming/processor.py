"""Running a pipeline: as a batch replay, or as a stream with a checkpoint.

``build`` turns the log into output rows; the same function serves both. A micro-batch writes the main output, then the
dead letters, and only when both are written does Spark commit the batch's offsets, so nothing is committed that is not
delivered (at least once; exactly once with sinks that skip a batch id they have seen).

Dead-letter limits count over the whole stream: each batch writes its counters by log partition beside the checkpoint,
under its id, and goes on from those of the batch before it, so a batch that runs again counts once. A partition's
counters start at the first offset that the stream reads of it.
"""

from __future__ import annotations

import threading
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.session import files_of
from millrace.operators import dlq
from millrace.streaming.metrics import Deliveries, ProgressListener, Watchdog

Build = Callable[[DataFrame], DataFrame]
Sink = Callable[[DataFrame, int], None]


@dataclass
class Pipeline:
    """What to run: how to build the output, where it goes, and what is invalid."""

    build: Build
    sink: Sink
    invalid: Column | None = None
    dead_letters: dlq.DlqConfig | None = None
    dead_letter_sink: Sink | None = None
    commit_log: Sink | None = None
    reason: str = "invalid"


def parquet_sink(path: str) -> Sink:
    """Append by batch id: a batch that is written again replaces its own files."""

    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def noop_sink(df: DataFrame, batch_id: int) -> None:
    df.write.format("noop").mode("overwrite").save()


def measured(sink: Sink, deliveries: Deliveries) -> Sink:
    """The sink, with status and latency of its deliveries reported; a micro-batch is one delivery."""

    def write(df: DataFrame, batch_id: int) -> None:
        with deliveries.one():
            sink(df, batch_id)

    return write


class Counters:
    """Counters of the dead-letter limits by batch id, as small tables in a folder; without one, in memory."""

    def __init__(self, folder: str | None = None) -> None:
        self.folder, self.held = folder, {}

    def before(self, log: DataFrame, batch_id: int) -> DataFrame:
        """Those of the last batch before this one, and of partitions that are new: the offset before their first row."""
        spark = log.sparkSession
        start = log.groupBy("topic", "partition").agg((F.min("offset") - 1).alias("last")).select("topic", "partition", "last", *[F.lit(0).cast("long").alias(c) for c in ("valid", "invalid", "run")])
        earlier = max((b for b in self._batches(spark) if b < batch_id), default=None)
        if earlier is None:
            return start
        old = spark.read.schema(dlq.COUNTERS).parquet(f"{self.folder}/{earlier}") if self.folder else spark.createDataFrame(self.held[earlier], dlq.COUNTERS)
        return old.unionByName(start.join(F.broadcast(old), ["topic", "partition"], "left_anti"))

    def write(self, counters: DataFrame, batch_id: int) -> None:
        """One row for each log partition. Counters of batches that can't run again are deleted."""
        spark = counters.sparkSession
        if not self.folder:
            self.held = {b: rows for b, rows in self.held.items() if b == batch_id - 1} | {batch_id: counters.collect()}
            return
        counters.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")
        files, path = files_of(spark, self.folder)
        for b in self._batches(spark):
            if b < batch_id - 1:
                files.delete(path(f"{self.folder}/{b}"), True)

    def _batches(self, spark: object) -> list[int]:
        if not self.folder:
            return list(self.held)
        files, path = files_of(spark, self.folder)
        done = lambda s: files.exists(path(f"{s.getPath()}/_SUCCESS"))
        return [int(s.getPath().getName()) for s in files.listStatus(path(self.folder)) if done(s)] if files.exists(path(self.folder)) else []


def run_batch(pipeline: Pipeline, log: DataFrame, batch_id: int = 0, counters: Counters | None = None) -> None:
    """One batch: split, write the output, then the dead letters, then the progress. ``counters`` carry the dead-letter
    limits from batch to batch; without them the batch is counted on its own, from its first offsets."""
    if pipeline.invalid is None:
        pipeline.sink(pipeline.build(log), batch_id)
    else:
        held = log.persist()
        try:
            valid, invalid = dlq.split(dlq.validate(held, pipeline.invalid, pipeline.reason))
            pipeline.sink(pipeline.build(valid), batch_id)
            if pipeline.dead_letters is not None and pipeline.dead_letter_sink is not None:
                _dead_letters(pipeline, held, invalid, batch_id, counters or Counters())
        finally:
            held.unpersist()
    if pipeline.commit_log is not None:
        pipeline.commit_log(log, batch_id)


def _dead_letters(pipeline: Pipeline, log: DataFrame, invalid: DataFrame, batch_id: int, counters: Counters) -> None:
    config, place = pipeline.dead_letters, ["topic", "partition", "offset"]
    after = None
    if config.limit != dlq.DlqLimit():
        before = counters.before(log, batch_id)
        limited = dlq.apply_limit(invalid, config.limit, counters=before)
        after = dlq.counters_after(limited, before)
        invalid = dlq.enforce(limited, config.on_limit)
    if config.buffered:
        buffer = dlq.buffered(log, config.buffered).select(*place)
        evicted = invalid.join(buffer, place, "left_anti").count()
        if evicted:
            warnings.warn(f"{evicted} invalid messages are no longer in the buffer", stacklevel=2)
        invalid = invalid.join(buffer, place, "left_semi")
    pipeline.dead_letter_sink(dlq.dead_letters(invalid, config.topic), batch_id)
    if after is not None:
        counters.write(after, batch_id)


def run_stream(pipeline: Pipeline, log: DataFrame, checkpoint: str, name: str | None = None, **trigger: object) -> StreamingQuery:
    """Start the stream; ``trigger`` as in ``writeStream.trigger`` (availableNow by default)."""
    counters = Counters(f"{checkpoint.rstrip('/')}/dead-letter-counters")
    writer = log.writeStream.foreachBatch(lambda df, batch_id: run_batch(pipeline, df, batch_id, counters)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True}))
    return (writer.queryName(name) if name else writer).start()


@dataclass
class Handle:
    """Stops a running processor from outside."""

    _stop: threading.Event = field(default_factory=threading.Event)

    def signal_shutdown(self) -> None:
        self._stop.set()

    @property
    def stopping(self) -> bool:
        return self._stop.is_set()


class Processor:
    """Runs a pipeline's stream until it ends, fails or is told to stop; reports progress and watches for stalls."""

    def __init__(self, pipeline: Pipeline, log: DataFrame, checkpoint: str, listener: ProgressListener | None = None, stuck_seconds: float | None = None, on_stuck: Callable[[str], None] = print, **trigger: object) -> None:
        self.pipeline, self.log, self.checkpoint, self.trigger = pipeline, log, checkpoint, trigger
        self.listener, self.stuck_seconds, self.on_stuck, self.handle = listener, stuck_seconds, on_stuck, Handle()

    def run(self, poll: float = 0.2) -> StreamingQuery:
        """Blocks. The query's own exception is raised after it ended."""
        streams = self.log.sparkSession.streams
        if self.listener:
            streams.addListener(self.listener)
        try:
            query = run_stream(self.pipeline, self.log, self.checkpoint, **self.trigger)
            watchdog = Watchdog(query, self.stuck_seconds, self.on_stuck) if self.stuck_seconds else None
            while query.isActive and not self.handle.stopping:
                query.awaitTermination(poll)
                if watchdog:
                    watchdog.check()
            if self.handle.stopping:
                query.stop()
            if query.exception():
                raise query.exception()
            return query
        finally:
            if self.listener:
                streams.removeListener(self.listener)
