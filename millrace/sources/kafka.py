"""Options for Spark's Kafka source and sink. The connector is not bundled: these build and check option dicts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

# Consumer defaults in use.
DEFAULT_QUEUED_MAX_MESSAGES_KBYTES = 50_000
DEFAULT_QUEUED_MIN_MESSAGES = 10_000
DEFAULT_STATISTICS_INTERVAL_MS = 1_000

_EARLIEST, _LATEST = ("smallest", "earliest", "beginning"), ("largest", "latest", "end")


def as_bool(value: object) -> bool:
    """A Kafka boolean: a bool, 0 or 1, or one of the strings true, t, 1, false, f, 0 in any case."""
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        if value in (0, 1):
            return bool(value)
        raise ValueError(f"not a boolean: {value!r}")
    if isinstance(value, str):
        known = {"true": True, "t": True, "1": True, "false": False, "f": False, "0": False}
        if value.lower() in known:
            return known[value.lower()]
        raise ValueError(f"not a boolean: {value!r}")
    raise TypeError(f"not a boolean: {value!r}")


def base_options(servers: list[str] | str, overrides: dict | None = None) -> dict[str, str]:
    """Common options; every override becomes a ``kafka.`` option."""
    joined = servers if isinstance(servers, str) else ",".join(servers)
    return {"kafka.bootstrap.servers": joined} | {f"kafka.{k.removeprefix('kafka.')}": str(v).lower() if isinstance(v, bool) else str(v) for k, v in (overrides or {}).items()}


def offsets_json(topic: str, offsets: dict[int, int]) -> str:
    if any(o < 0 for o in offsets.values()):
        raise ValueError("negative offset")
    return json.dumps({topic: {str(p): o for p, o in sorted(offsets.items())}})


def consumer_options(servers: list[str] | str, topics: str | list[str], group: str | None = None, auto_offset_reset: str = "earliest", strict_offset_reset: bool = True, max_offsets_per_trigger: int | None = None, min_partitions: int | None = None, starting: str | None = None, ending: str | None = None, overrides: dict | None = None) -> dict[str, str]:
    """Options of a reader. The reset policy only holds without a checkpoint; strict: lost offsets fail the query."""
    if auto_offset_reset not in (*_EARLIEST, *_LATEST, "error"):
        raise ValueError(f"unknown offset reset: {auto_offset_reset}")
    if auto_offset_reset == "error" and starting is None:
        raise ValueError("without an offset reset, starting offsets must be given")
    reset = "latest" if auto_offset_reset in _LATEST else "earliest"
    fetch = {"fetch.max.bytes": DEFAULT_QUEUED_MAX_MESSAGES_KBYTES * 1024, "max.poll.records": DEFAULT_QUEUED_MIN_MESSAGES}
    options = base_options(servers, fetch | (overrides or {}))
    options |= {"subscribe": topics if isinstance(topics, str) else ",".join(topics), "startingOffsets": starting or reset, "failOnDataLoss": str(bool(strict_offset_reset)).lower(), "includeHeaders": "true"}
    if group:
        options["kafka.group.id"] = group
    for name, value in (("maxOffsetsPerTrigger", max_offsets_per_trigger), ("minPartitions", min_partitions), ("endingOffsets", ending)):
        if value is not None:
            options[name] = str(value)
    return options


def producer_options(servers: list[str] | str, topic: str | None = None, overrides: dict | None = None) -> dict[str, str]:
    return base_options(servers, overrides) | ({"topic": topic} if topic else {}) | {"includeHeaders": "true"}


def read(spark: SparkSession, options: dict[str, str], stream: bool = True) -> DataFrame:
    reader = (spark.readStream if stream else spark.read).format("kafka").options(**options)
    return reader.load().drop("timestampType")


def write_stream(records: DataFrame, options: dict[str, str], checkpoint: str) -> DataStreamWriter:
    return records.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
