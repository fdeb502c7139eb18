"""Metrics of running queries: a backend protocol, StatsD lines, a progress listener, deliveries, error names, health files,
a watchdog, retries."""

from __future__ import annotations

import json
import os
import re
import sys
import threading
import time
import traceback
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from typing import Any, Protocol

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

Tags = Mapping[str, str]


class Metrics(Protocol):
    def increment(self, name: str, value: float = 1, tags: Tags | None = None) -> None: ...
    def gauge(self, name: str, value: float, tags: Tags | None = None) -> None: ...
    def timing(self, name: str, value: float, tags: Tags | None = None) -> None: ...


class DummyMetrics:
    """Discards everything."""

    def increment(self, name: str, value: float = 1, tags: Tags | None = None) -> None:
        pass

    def gauge(self, name: str, value: float, tags: Tags | None = None) -> None:
        pass

    def timing(self, name: str, value: float, tags: Tags | None = None) -> None:
        pass


class StatsdMetrics:
    """Lines ``prefix.name:value|type|#key:value,...`` into a sink; times are milliseconds."""

    def __init__(self, prefix: str, sink: Callable[[str], None], tags: Tags | None = None) -> None:
        self.prefix, self.sink, self.tags = prefix, sink, dict(tags or {})

    def with_tag(self, key: str, value: str) -> StatsdMetrics:
        return StatsdMetrics(self.prefix, self.sink, self.tags | {key: value})

    def _send(self, name: str, value: float, kind: str, tags: Tags | None) -> None:
        every = self.tags | dict(tags or {})
        number = f"{value:g}" if isinstance(value, float) else str(value)
        self.sink(f"{self.prefix}.{name}:{number}|{kind}" + ("|#" + ",".join(f"{k}:{v}" for k, v in every.items()) if every else ""))

    def increment(self, name: str, value: float = 1, tags: Tags | None = None) -> None:
        self._send(name, value, "c", tags)

    def gauge(self, name: str, value: float, tags: Tags | None = None) -> None:
        self._send(name, value, "g", tags)

    def timing(self, name: str, value: float, tags: Tags | None = None) -> None:
        self._send(name, value, "ms", tags)


_backend: Metrics = DummyMetrics()
_configured = False


def configure_metrics(backend: Metrics, force: bool = False) -> None:
    """Set the process's backend, once unless forced."""
    global _backend, _configured
    if _configured and not force:
        raise RuntimeError("metrics are configured already")
    _backend, _configured = backend, True


def get_metrics() -> Metrics:
    return _backend


class Gauge:
    """A number that goes up and down and is reported on every change."""

    def __init__(self, metrics: Metrics, name: str, tags: Tags | None = None) -> None:
        self.metrics, self.name, self.tags, self.value = metrics, name, tags, 0

    def __enter__(self) -> Gauge:
        self.increment()
        return self

    def __exit__(self, *_: object) -> None:
        self.decrement()

    def increment(self) -> None:
        self.value += 1
        self.metrics.gauge(self.name, self.value, self.tags)

    def decrement(self) -> None:
        self.value -= 1
        self.metrics.gauge(self.name, self.value, self.tags)


def observed(df: DataFrame, name: str = "millrace") -> DataFrame:
    """Count rows and note their oldest and newest timestamps (epoch seconds) while they pass; the values come with the
    query's progress, where the listener turns the oldest one into the consumer's latency."""
    seconds = F.unix_micros(F.col("timestamp")) / 1e6
    return df.observe(name, F.count(F.lit(1)).alias("messages"), F.min(seconds).alias("oldest"), F.max(seconds).alias("newest"))


class ProgressListener(StreamingQueryListener):
    """Reports every micro-batch and keeps the health file fresh."""

    def __init__(self, metrics: Metrics | None = None, health: HealthFile | None = None) -> None:
        self.metrics, self.health = metrics or get_metrics(), health

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        self.metrics.increment("query.started")

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        progress = event.progress
        tags = {"query": progress.name or str(progress.id)}
        self.metrics.increment("batch.rows", progress.numInputRows, tags)
        for step, ms in (progress.durationMs or {}).items():
            self.metrics.timing(f"batch.{step}", ms, tags)
        for name, row in (progress.observedMetrics or {}).items():
            for key, value in row.asDict().items():
                if value is not None:
                    self.metrics.gauge(f"{name}.{key}", value, tags)
                if value is not None and key == "oldest":
                    self.metrics.gauge(f"{name}.latency_seconds", time.time() - value, tags)
        if self.health:
            self.health.touch()

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        if self.health:
            self.health.touch()

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        if event.exception:
            self.metrics.increment("query.failed", 1, {"error": error_name(event.exception)})
        else:
            self.metrics.increment("query.stopped")


def kafka_statistics(text: str, metrics: Metrics) -> None:
    """Gauges of a Kafka client's statistics report (JSON); latencies go from microseconds to milliseconds."""
    stats = json.loads(text)
    for name, key in (("message_count", "msg_cnt"), ("message_count_max", "msg_max"), ("message_size", "msg_size"), ("message_size_max", "msg_size_max"), ("reply_queue_size", "replyq")):
        if key in stats:
            metrics.gauge(f"producer.librdkafka.{name}", stats[key])
    for broker, own in (stats.get("brokers") or {}).items():
        tags = {"broker_id": str(own.get("nodeid", broker))}
        for key in ("int_latency", "outbuf_latency", "rtt"):
            if (own.get(key) or {}).get("p99"):
                metrics.timing(f"producer.librdkafka.p99_{key}", own[key]["p99"] / 1000, tags)
        for name, key in (("broker_txerrs", "txerrs"), ("broker_txretries", "txretries")):
            if own.get(key):
                metrics.gauge(f"producer.librdkafka.{name}", own[key], tags)


_JAVA_CLASS = re.compile(r"^(?:Caused by: |: )?((?:[a-z_]\w*\.)+[A-Z][\w$]*)(?=:|\s*$)", re.MULTILINE)


def error_name(error: BaseException | str) -> str:
    """A short name of an error for logs and tags: the class of its innermost Java cause if its text tells one, without
    package and ending; else its condition, as Spark names it, or its own class."""
    causes = _JAVA_CLASS.findall(str(error))
    if causes:
        return re.sub(r"(?<=.)(Exception|Error)$", "", re.split(r"[.$]", causes[-1])[-1])
    if isinstance(error, PySparkException) and error.getCondition():
        return error.getCondition()
    return type(error).__name__ if isinstance(error, BaseException) else "Unknown"


class Deliveries:
    """Counts deliveries by status and keeps their latencies; reports both at most once in ``every`` seconds, and when
    flushed. Latencies are milliseconds."""

    def __init__(self, name: str | None = None, metrics: Metrics | None = None, every: float = 1.0, clock: Callable[[], float] = time.time) -> None:
        self.name, self.metrics, self.every, self.clock = name, metrics or get_metrics(), every, clock
        self._lock, self._counts, self._times, self._last = threading.Lock(), {}, [], clock()

    @contextmanager
    def one(self) -> Iterator[None]:
        """Around one delivery; an error counts as such and goes on."""
        begun = self.clock()
        try:
            yield
        except BaseException:
            self._note("error", begun)
            raise
        self._note("success", begun)

    def _note(self, status: str, begun: float) -> None:
        now = self.clock()
        with self._lock:
            self._counts[status] = self._counts.get(status, 0) + 1
            self._times.append((now - begun) * 1000)
            due = now - self._last > self.every
        if due:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            counts, self._counts = self._counts, {}
            times, self._times = self._times, []
            self._last = self.clock()
        named = {"producer_name": self.name} if self.name else {}
        for status, count in counts.items():
            self.metrics.increment("producer.produce_status", count, {"status": status} | named)
        for ms in times:
            self.metrics.timing("producer.callback_latency", ms, named or {"producer_name": "N/A"})


class HealthFile:
    """A file that is touched at most once in ``every`` seconds while the query makes progress."""

    def __init__(self, path: str, every: float = 1.0, clock: Callable[[], float] = time.time) -> None:
        self.path, self.every, self.clock, self.last = path, every, clock, None

    def touch(self) -> bool:
        now = self.clock()
        if self.last is not None and now - self.last < self.every:
            return False
        with open(self.path, "a", encoding="utf-8"):
            os.utime(self.path)
        self.last = now
        return True


def thread_stacks() -> str:
    """The stacks of all threads."""
    names = {t.ident: t.name for t in threading.enumerate()}
    return "\n".join(f"Thread {names.get(i, i)}\n{''.join(traceback.format_stack(frame))}" for i, frame in sys._current_frames().items())  # noqa: SLF001


class Watchdog:
    """Calls ``on_stuck`` with all stacks once when a query shows no new progress for ``timeout`` seconds."""

    def __init__(self, query: StreamingQuery, timeout: float, on_stuck: Callable[[str], None], clock: Callable[[], float] = time.monotonic) -> None:
        self.query, self.timeout, self.on_stuck, self.clock = query, timeout, on_stuck, clock
        self.seen, self.since, self.told = None, clock(), False

    def check(self) -> bool:
        last = self.query.lastProgress
        mark = None if last is None else (last["batchId"], last["timestamp"])
        if mark != self.seen:
            self.seen, self.since, self.told = mark, self.clock(), False
        stuck = self.query.isActive and self.clock() - self.since >= self.timeout
        if stuck and not self.told:
            self.told = True
            get_metrics().increment("query.stuck")
            self.on_stuck(thread_stacks())
        return stuck


class RetryError(Exception):
    """All attempts failed."""


def retry(function: Callable[[], Any], attempts: int, delay: float | Callable[[int], float] = 0.0, suppress: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Call until it succeeds, at most ``attempts`` times. An error that ``suppress`` declines is raised at once."""
    if attempts < 1:
        raise ValueError("at least one attempt")
    for n in range(1, attempts + 1):
        try:
            return function()
        except Exception as error:
            if not suppress(error):
                raise
            if n == attempts:
                raise RetryError(f"failed {attempts} times") from error
            sleep(delay(n) if callable(delay) else delay)
    return None
