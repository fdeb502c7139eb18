"""The log envelope: one row per message, with the column names of Spark's Kafka source.

``topic, partition, offset, timestamp, key, value, headers``. A message's *committable* is the next offset to read of its
partition, offset + 1; an aggregated row carries an array of them. ``is_filtered`` marks a row that has no payload any
more but still advances offsets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from millrace.functions.session import shared_folder

HEADER = StructType([StructField("key", StringType()), StructField("value", BinaryType())])
ENVELOPE = StructType(
    [
        StructField("topic", StringType()),
        StructField("partition", IntegerType()),
        StructField("offset", LongType()),
        StructField("timestamp", TimestampType()),
        StructField("key", BinaryType()),
        StructField("value", BinaryType()),
        StructField("headers", ArrayType(HEADER)),
    ]
)
COMMITTABLE = StructType([StructField("topic", StringType()), StructField("partition", IntegerType()), StructField("next_offset", LongType())])
#: What orders messages: place in the log.
PLACE = ["topic", "partition", "offset"]


def no_headers() -> Column:
    return F.array().cast(ArrayType(HEADER))


def as_log(df: DataFrame, topic: str, partition: Column, order_by: list[str], timestamp: str, key: Column | None = None, value: Column | None = None, keep: list[str] | None = None, dense: str = "window") -> DataFrame:
    """Give a table the envelope. Offsets are dense from 0 in each partition, in ``order_by`` order.

    ``dense="window"`` numbers a log partition in one task. ``dense="range"`` splits it: rows are sorted over ranges of
    (partition, order), written under the shared folder, and each range starts from the count of the rows before it; use
    it where a log partition outgrows a task, and write the result, since offsets of a real log are stored.
    """
    base = df.withColumn("partition", partition.cast("int"))
    order = [F.col(c) for c in order_by]
    if dense == "window":
        numbered = base.withColumn("offset", (F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1).cast("long"))
    else:
        numbered = _range_numbered(base, order_by)
    columns = [
        F.lit(topic).alias("topic"),
        "partition",
        "offset",
        F.col(timestamp).cast("timestamp").alias("timestamp"),
        (key if key is not None else F.lit(None)).cast("binary").alias("key"),
        (value if value is not None else F.lit(None)).cast("binary").alias("value"),
        no_headers().alias("headers"),
    ]
    return numbered.select(*columns, *(keep or []))


def _range_numbered(base: DataFrame, order_by: list[str]) -> DataFrame:
    # written, so that the rows that are counted are those that are numbered
    path = f"{shared_folder(base.sparkSession)}/ranges-{uuid.uuid4().hex}"
    sorted_rows = base.repartitionByRange("partition", *order_by).sortWithinPartitions("partition", *order_by)
    sorted_rows.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    placed = base.sparkSession.read.parquet(path)
    ranges = placed.groupBy("partition", F.shiftright("__id", 33).alias("__range")).agg(F.count("*").alias("__rows"), F.min("__id").alias("__least"))
    # one row for each range and log partition
    before = Window.partitionBy("partition").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("partition", "__range", "__least", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    met = placed.withColumn("__range", F.shiftright("__id", 33)).join(F.broadcast(starts), ["partition", "__range"])
    return met.withColumn("offset", F.col("__before") + F.col("__id") - F.col("__least")).drop("__id", "__range", "__least", "__before")


def without_nulls(log: DataFrame) -> DataFrame:
    """Tombstones as the classic consumer shows them: a null value is empty, null headers are no headers."""
    return log.withColumn("value", F.coalesce("value", F.lit(b""))).withColumn("headers", F.coalesce("headers", no_headers()))


def next_offset() -> Column:
    return F.col("offset") + 1


def previous_offset() -> Column:
    """The offset of the row that a committable stands for."""
    return F.col("next_offset") - 1


def committable() -> Column:
    """The single committable of a log row."""
    return F.array(F.struct("topic", "partition", next_offset().alias("next_offset")))


def progress(rows: DataFrame) -> DataFrame:
    """topic, partition, next_offset: the merged progress of rows (the greatest by partition)."""
    return rows.groupBy("topic", "partition").agg(F.max(next_offset()).alias("next_offset"))


def merge_committables(rows: DataFrame, column: str = "committable") -> DataFrame:
    """The greatest next offset by partition over rows that carry arrays of committables."""
    return rows.select(F.explode(column).alias("c")).groupBy("c.topic", "c.partition").agg(F.max("c.next_offset").alias("next_offset"))


def header(name: str, headers: str = "headers") -> Column:
    """The first header of that name (null without one)."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(1))["value"]


def with_header(name: str, value: Column, headers: str = "headers") -> Column:
    return F.concat(F.coalesce(F.col(headers), no_headers()), F.array(F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))))


def replace_payload(log: DataFrame, value: Column) -> DataFrame:
    """Another payload at the same place with the same timestamp."""
    return log.withColumn("value", value)


def record(log: DataFrame, topic: str | None = None, partition: Column | None = None) -> DataFrame:
    """The columns that a Kafka sink writes: topic, key, value, headers and, if given, the partition."""
    out = log.select((F.lit(topic) if topic else F.col("topic")).alias("topic"), "key", "value", "headers", *([partition.cast("int").alias("partition")] if partition is not None else []))
    return out


def watermarks(log: DataFrame) -> DataFrame:
    """Low and high marks of each partition: the first offset, and the one after the last."""
    return log.groupBy("topic", "partition").agg(F.min("offset").alias("low"), F.max(next_offset()).alias("high"))


def start_offsets(marks: DataFrame, committed: DataFrame | None = None, reset: str = "latest", strict: bool = True) -> DataFrame:
    """Where each partition starts: its committed offset, else by the reset policy (earliest, latest, error).

    A committed offset outside the marks is an error if ``strict``, else it is reset too.
    """
    policy = {**dict.fromkeys(("smallest", "earliest", "beginning"), "low"), **dict.fromkeys(("largest", "latest", "end"), "high"), "error": None}
    if reset not in policy:
        raise ValueError(f"unknown offset reset: {reset}")
    both = marks if committed is None else marks.join(committed, ["topic", "partition"], "left")
    given = F.col("next_offset") if committed is not None else F.lit(None).cast("long")
    fail = lambda text: F.raise_error(F.format_string(text + " in %s/%d", "topic", "partition")).cast("long")
    fallback = F.col(policy[reset]) if policy[reset] else fail("no committed offset")
    valid = given.between(F.col("low"), F.col("high"))
    start = F.when(given.isNull(), fallback).when(valid, given).otherwise(fail("offset out of range") if strict else fallback)
    return both.select("topic", "partition", start.alias("start_offset"))


def seek(log: DataFrame, ranges: dict[int, tuple[int, int | None]]) -> DataFrame:
    """Rows of the given partitions from an offset up to (not including) another; a filter that scans can use."""
    if any(p < 0 or a < 0 for p, (a, _) in ranges.items()):
        raise ValueError("negative partition or offset")
    wanted = F.lit(False)
    for p, (a, b) in ranges.items():
        own = (F.col("partition") == p) & (F.col("offset") >= a)
        wanted = wanted | (own if b is None else own & (F.col("offset") < b))
    return log.filter(wanted)
