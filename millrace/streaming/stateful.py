"""Stateful stream operators: the batching fold with size and time bounds, and dead-letter limits across micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.session import ship
from millrace.operators.dlq import DlqLimit

BATCH_SCHEMA = "topic string, partition int, values array<binary>, next_offset bigint, timestamp timestamp"


class BatchProcessor(StatefulProcessor):
    """Collects values of a log partition until ``max_size`` is reached or ``max_seconds`` have passed since the batch
    began. Values are bytes. Subclasses may change ``is_ready``, ``weigh`` and ``value`` (bytes of another payload)."""

    def __init__(self, max_size: float, max_seconds: float | None = None, weigh: Callable[[dict], float] | None = None) -> None:
        self.max_size, self.max_seconds, self.weigh = max_size, max_seconds, weigh or (lambda row: 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getListState("items", "value binary, offset bigint, timestamp timestamp")
        self.meta = handle.getValueState("meta", "size double, deadline bigint")

    def value(self, row: dict) -> bytes | None:
        raw = row["value"]
        return None if raw is None else bytes(raw)

    def is_ready(self, size: float) -> bool:
        return size >= self.max_size

    def _flush(self, key: tuple) -> dict:
        items = list(self.items.get())
        self.items.clear()
        self.meta.clear()
        if self.max_seconds is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        return {"topic": key[0], "partition": key[1], "values": [i[0] for i in items], "next_offset": items[-1][1] + 1, "timestamp": items[-1][2]}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        frames = list(rows)  # a micro-batch of one log partition; its arrival order is not defined
        for row in pd.concat(frames).sort_values("offset").to_dict("records") if frames else ():
            size = (self.meta.get()[0] if self.meta.exists() else 0.0) + self.weigh(row)
            if not self.meta.exists() and self.max_seconds is not None:
                deadline = timerValues.getCurrentProcessingTimeInMs() + int(self.max_seconds * 1000)
                self.handle.registerTimer(deadline)
                self.meta.update((size, deadline))
            else:
                self.meta.update((size, self.meta.get()[1] if self.meta.exists() else 0))
            self.items.appendValue((self.value(row), row["offset"], row["timestamp"]))
            if self.is_ready(size):
                out.append(self._flush(key))
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.items.exists():
            yield pd.DataFrame([self._flush(key)])

    def close(self) -> None:
        pass


def batch_stream(log: DataFrame, processor: BatchProcessor, timed: bool | None = None) -> DataFrame:
    """Batches of a streaming log, by log partition; state is in the state store and survives restarts. An open batch
    stays open when the stream ends: it is flushed by later rows, or by its timer."""
    timed = processor.max_seconds is not None if timed is None else timed
    ship(log.sparkSession)
    keyed = log.select("topic", "partition", "offset", "timestamp", "value").groupBy("topic", "partition")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=BATCH_SCHEMA, outputMode="Append", timeMode="ProcessingTime" if timed else "None")


class LimitProcessor(StatefulProcessor):
    """Dead-letter limits with counters that live in the state store; ``assigned`` gives the offset from which a
    partition is read. ``reset_on_start`` would be a new checkpoint."""

    def __init__(self, limit: DlqLimit, compat: bool = True, assigned: dict[int, int] | None = None) -> None:
        self.limit, self.extra, self.assigned = limit, 1 if compat else -1, assigned or {}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("counters", "last bigint, valid bigint, invalid bigint, consecutive bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        last, valid, invalid, run = self.state.get() if self.state.exists() else (self.assigned[key[1]] - 1 if key[1] in self.assigned else None, 0, 0, 0)
        frames = list(rows)
        for offset in sorted(pd.concat(frames)["offset"].tolist()) if frames else ():
            if last is None:
                run = 1
            elif offset <= last:
                continue  # seen before
            elif offset == last + 1:
                run += 1
            else:
                valid, run = valid + offset - last + self.extra, 1
            invalid, last = invalid + 1, offset
            ratio, most = self.limit.max_invalid_ratio, self.limit.max_consecutive_count
            good = (ratio is None or valid > 0 and invalid / valid <= ratio) and (most is None or run <= most)
            out.append({"topic": key[0], "partition": key[1], "offset": offset, "accepted": good})
        self.state.update((last, valid, invalid, run))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def limit_stream(invalid: DataFrame, limit: DlqLimit, compat: bool = True, assigned: dict[int, int] | None = None) -> DataFrame:
    ship(invalid.sparkSession)
    keyed = invalid.select("topic", "partition", "offset").groupBy("topic", "partition")
    return keyed.transformWithStateInPandas(statefulProcessor=LimitProcessor(limit, compat, assigned), outputStructType="topic string, partition int, offset bigint, accepted boolean", outputMode="Append", timeMode="None")
