"""Commit policies, the commit log and its codec."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.envelope import header, next_offset
from millrace.operators.steps import ordered_fold


@dataclass(frozen=True)
class CommitPolicy:
    """Commit when so many seconds or so many offsets have passed; at least one must be given."""

    min_commit_frequency_sec: float | None = None
    min_commit_messages: int | None = None

    def __post_init__(self) -> None:
        if self.min_commit_frequency_sec is None and self.min_commit_messages is None:
            raise ValueError("a commit policy needs a frequency or a number of messages")

    def trigger(self) -> dict:
        """The trigger of a stream that commits once a micro-batch."""
        return {"processingTime": f"{self.min_commit_frequency_sec} seconds"} if self.min_commit_frequency_sec else {"processingTime": "0 seconds"}

    def state(self, now: float = 0.0) -> CommitPolicyState:
        return CommitPolicyState(self, now)


IMMEDIATE = CommitPolicy(None, 1)
ONCE_PER_SECOND = CommitPolicy(1, None)


@dataclass
class CommitPolicyState:
    """The policy's decisions on a sequence of positions (offsets by partition)."""

    policy: CommitPolicy
    last_time: float
    committed: dict = field(default_factory=dict)

    def should_commit(self, now: float, offsets: dict) -> bool:
        p = self.policy
        if p.min_commit_frequency_sec is not None and now - self.last_time >= p.min_commit_frequency_sec:
            return True
        if p.min_commit_messages is None:
            return False
        for key, position in offsets.items():
            self.committed.setdefault(key, position - 1)
        return sum(position - self.committed[key] for key, position in offsets.items()) >= p.min_commit_messages

    def did_commit(self, now: float, offsets: dict) -> None:
        self.last_time = now
        self.committed |= offsets


def commits(rows: DataFrame, policy: CommitPolicy, scope: list[str] | None = None) -> DataFrame:
    """The rows after which the policy commits, in offset order by ``scope`` (one log partition by default), with
    ``commit_no``. Time is the rows' own."""
    schema = "topic string, partition int, next_offset bigint, timestamp timestamp, commit_no bigint"

    def step(state: dict, row: dict) -> Iterator[dict]:
        now = row["timestamp"].timestamp() if policy.min_commit_frequency_sec is not None else 0.0
        if not state:
            state |= {"policy": policy.state(now), "n": 0}
        position = {row["partition"]: row["offset"] + 1}
        if state["policy"].should_commit(now, position):
            state["policy"].did_commit(now, position)
            state["n"] += 1
            yield {"topic": row["topic"], "partition": row["partition"], "next_offset": row["offset"] + 1, "timestamp": row["timestamp"], "commit_no": state["n"]}

    return ordered_fold(rows.select("topic", "partition", "offset", "timestamp"), step, lambda state: (), schema, scope)


def dense_commits(rows: DataFrame, messages: int) -> DataFrame:
    """``commits`` for a count policy over dense log partitions, without a fold: the first message commits when it
    suffices, then every ``messages`` offsets from the partition's first one."""
    # one row for each log partition, so no window holds a partition
    first = rows.groupBy("topic", "partition").agg(F.min("offset").alias("first"))
    since = F.col("offset") - F.col("first") + 1
    met = rows.select("topic", "partition", "offset").join(F.broadcast(first), ["topic", "partition"])
    return met.filter(since % messages == 0).select("topic", "partition", next_offset().alias("next_offset"), (since / messages).cast("long").alias("commit_no"))


# the commit log: key topic:partition:group, value JSON


def commit_log(log: DataFrame, group: str, received_p99: Column | None = None) -> DataFrame:
    """Commit records of a log's progress: group, topic, partition, offset, orig_message_ts, received_p99."""
    last = log.groupBy("topic", "partition").agg(F.max(next_offset()).alias("offset"), F.max_by("timestamp", "offset").alias("ts"))
    return last.select(F.lit(group).alias("group"), "topic", "partition", "offset", F.unix_micros("ts").cast("double").alias("orig_us"), (received_p99 if received_p99 is not None else F.lit(None)).cast("double").alias("received_p99")).select(
        "group", "topic", "partition", "offset", (F.col("orig_us") / 1e6).alias("orig_message_ts"), "received_p99"
    )


def encode(records: DataFrame) -> DataFrame:
    """Key and value of the commit log's messages. A group must not hold a colon: the key could not be split again."""
    group = F.when(F.col("group").contains(":"), F.raise_error(F.lit("a group with a colon can't be encoded")).cast("string")).otherwise(F.col("group"))
    key = F.concat_ws(":", "topic", F.col("partition").cast("string"), group)
    value = F.to_json(F.struct("offset", "orig_message_ts", "received_p99"), {"ignoreNullFields": "false"})
    return records.select(F.encode(key, "UTF-8").alias("key"), F.encode(value, "UTF-8").alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """Commit records of messages. A value that is a bare number is of the old form, whose time is a header."""
    parts = F.split(F.decode("key", "UTF-8"), ":")
    text = F.decode("value", "UTF-8")
    old = text.rlike("^[0-9]+$")
    new = F.from_json(F.when(~old, text), "offset bigint, orig_message_ts double, received_p99 double")
    columns = [parts[2].alias("group"), parts[0].alias("topic"), parts[1].cast("int").alias("partition")]
    time = F.decode(header("orig_message_ts"), "UTF-8") if "headers" in messages.columns else F.lit(None).cast("string")
    old_time = F.unix_micros(F.to_timestamp(time)).cast("double") / 1e6
    return messages.select(
        *columns,
        F.when(old, text.cast("long")).otherwise(new["offset"]).alias("offset"),
        F.when(old, old_time).otherwise(new["orig_message_ts"]).alias("orig_message_ts"),
        F.when(~old & (new["received_p99"] != 0), new["received_p99"]).alias("received_p99"),
    )


def latest_commits(records: DataFrame) -> DataFrame:
    """The furthest commit by group and partition; repeated and late records do not move it back."""
    return records.groupBy("group", "topic", "partition").agg(F.max("offset").alias("offset"))


def latency(log: DataFrame, now: Column) -> DataFrame:
    """Seconds between the messages' timestamps and now, by partition."""
    seconds = (F.unix_micros(now.cast("timestamp")) - F.unix_micros("timestamp")) / 1e6
    return log.groupBy("topic", "partition").agg(F.max(seconds).alias("max_latency"), F.min(seconds).alias("min_latency"))


def encode_record(group: str, topic: str, partition: int, offset: int, orig_message_ts: float, received_p99: float | None = None) -> tuple[bytes, bytes]:
    """One commit record on the driver, as ``encode`` writes it."""
    if ":" in group:
        raise ValueError("a group with a colon can't be encoded")
    return f"{topic}:{partition}:{group}".encode(), json.dumps({"offset": offset, "orig_message_ts": orig_message_ts, "received_p99": received_p99}).encode()
