"""Dead letters: splitting invalid rows off, limits on how many may be invalid, and the bounded message buffer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.envelope import next_offset, no_headers
from millrace.operators.steps import last_per_partition


@dataclass(frozen=True)
class DlqLimit:
    """Accept invalid rows of a partition while invalid / valid and the run of consecutive ones stay within these."""

    max_invalid_ratio: float | None = None
    max_consecutive_count: int | None = None


@dataclass(frozen=True)
class DlqConfig:
    """Where invalid rows go. ``on_limit``: fail the query, or drop the row. ``buffered``: how many last messages of a
    partition can still be found when a row turns out invalid (None: all, since rows keep their raw columns)."""

    topic: str
    limit: DlqLimit = DlqLimit()
    buffered: int | None = None
    on_limit: str = "fail"


def validate(df: DataFrame, invalid: Column, reason: Column | str = "invalid") -> DataFrame:
    """Flag rows: ``invalid`` and ``reason``. Use it before any batching, while a row is still one message."""
    flag = F.coalesce(invalid, F.lit(False))
    why = F.lit(reason) if isinstance(reason, str) else reason
    return df.withColumn("invalid", flag).withColumn("reason", F.when(flag, why))


def split(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, invalid rows). Together they are the input."""
    return validated.filter(~F.col("invalid")).drop("invalid", "reason"), validated.filter("invalid").drop("invalid")


def dead_letters(invalid: DataFrame, topic: str) -> DataFrame:
    """Rows for the dead-letter topic: the raw message with headers for its original place."""
    mark = lambda name, column: F.struct(F.lit(name).alias("key"), F.encode(F.col(column).cast("string"), "UTF-8").alias("value"))
    headers = F.concat(F.coalesce("headers", no_headers()), F.array(mark("original_partition", "partition"), mark("original_offset", "offset")))
    extra = [c for c in ("reason",) if c in invalid.columns]
    return invalid.select(F.lit(topic).alias("topic"), "key", "value", headers.alias("headers"), F.col("partition").alias("original_partition"), F.col("offset").alias("original_offset"), *extra)


#: Counters of a log partition: its last invalid offset, and valid, invalid and consecutive invalid rows so far.
COUNTERS = "topic string, partition int, last bigint, valid bigint, invalid bigint, run bigint"


def apply_limit(invalid: DataFrame, limit: DlqLimit, assigned: dict[int, int] | None = None, compat: bool = True, counters: DataFrame | None = None) -> DataFrame:
    """Add the counters of each invalid row and ``accepted``, in offset order within its partition.

    ``assigned`` gives the offset from which a partition is read: the row before it counts as the previous invalid one.
    ``counters`` (``COUNTERS``) go on from earlier rows, one row for each log partition; they go before ``assigned``.
    With ``compat`` a gap from offset L to o counts o - L + 1 valid rows, as deployed consumers do, otherwise
    o - L - 1. Rejected rows still count. Without valid rows a ratio limit rejects.
    """
    own = Window.partitionBy("topic", "partition").orderBy("offset")
    previous = F.lag("offset").over(own)
    before = {c: F.lit(0).cast("long") for c in ("valid", "invalid", "run")}
    if counters is not None:
        named = counters.select("topic", "partition", *[F.col(c).alias(f"__{c}") for c in ("last", *before)])
        invalid = invalid.join(F.broadcast(named), ["topic", "partition"], "left").withColumnRenamed("__last", "__earlier")
        previous = F.coalesce(previous, F.col("__earlier"))
        before = {c: F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in before}
    if assigned:
        pairs = [x for p, o in assigned.items() for x in (F.lit(p), F.lit(o - 1).cast("long"))]
        previous = F.coalesce(previous, F.try_element_at(F.create_map(*pairs), F.col("partition")))
    gap = (F.col("offset") - F.col("__last") + (1 if compat else -1)).cast("long")
    run = F.coalesce(F.col("offset") == F.col("__last") + 1, F.lit(False))
    df = invalid.withColumn("__last", previous)
    df = df.withColumn("__gap", F.when(F.col("__last").isNull() | run, F.lit(0).cast("long")).otherwise(gap))
    df = df.withColumn("__break", F.when(run, 0).otherwise(1))
    so_far = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("valid_count", F.sum("__gap").over(so_far) + before["valid"]).withColumn("invalid_count", F.count("*").over(so_far) + before["invalid"])
    df = df.withColumn("__island", F.sum("__break").over(so_far))
    island = Window.partitionBy("topic", "partition", "__island").orderBy("offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # rows without a break go on with the run before them
    df = df.withColumn("consecutive", F.count("*").over(island) + F.when(F.col("__island") == 0, before["run"]).otherwise(0))
    accepted = F.lit(True)
    if limit.max_invalid_ratio is not None:
        accepted = accepted & (F.col("valid_count") > 0) & (F.col("invalid_count") / F.when(F.col("valid_count") > 0, F.col("valid_count")) <= limit.max_invalid_ratio)
    if limit.max_consecutive_count is not None:
        accepted = accepted & (F.col("consecutive") <= limit.max_consecutive_count)
    return df.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__last", "__gap", "__break", "__island", "__earlier", *[f"__{c}" for c in before])


def counters_after(limited: DataFrame, counters: DataFrame) -> DataFrame:
    """``COUNTERS`` after rows to which ``apply_limit`` has added its own; partitions without such rows keep theirs."""
    last = limited.groupBy("topic", "partition").agg(F.max(F.struct("offset", "valid_count", "invalid_count", "consecutive")).alias("now"))
    met = counters.join(last, ["topic", "partition"], "full")
    new = lambda name, old: F.coalesce(F.col(f"now.{name}"), F.col(old)).alias(old)
    return met.select("topic", "partition", new("offset", "last"), new("valid_count", "valid"), new("invalid_count", "invalid"), new("consecutive", "run"))


def enforce(limited: DataFrame, on_limit: str = "fail") -> DataFrame:
    """Accepted rows; a rejected one fails the query or is dropped."""
    if on_limit == "drop":
        return limited.filter("accepted")
    if on_limit != "fail":
        raise ValueError(f"unknown on_limit: {on_limit}")
    message = F.format_string("dead-letter limit exceeded at %s/%d offset %d", "topic", "partition", "offset")
    return limited.filter(F.when(F.col("accepted"), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))


def invalid_progress(invalid: DataFrame) -> DataFrame:
    """Invalid rows advance offsets too: one coalesced sentinel, the greatest next offset by partition."""
    return invalid.groupBy("topic", "partition").agg(F.max(next_offset()).alias("next_offset")).withColumn("is_filtered", F.lit(True))


def buffered(log: DataFrame, count: int | None) -> DataFrame:
    """The raw messages that a buffer of that size still holds (None or 0: no limit)."""
    return last_per_partition(log, count) if count else log


def look_up(buffer: DataFrame, invalid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw messages of invalid rows, invalid rows whose message the buffer has evicted)."""
    place = ["topic", "partition", "offset"]
    return buffer.join(invalid.select(*place), place, "left_semi"), invalid.join(buffer.select(*place), place, "left_anti")
