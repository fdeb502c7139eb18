"""A log in files: topics as Parquet folders partitioned by topic and partition, offsets stored with the rows.

Batch reads and streams use Spark's own file source, so partition folders are pruned and offset filters reach the scan.
``LogDataSource`` is a Python source that streams by offsets, for consumers that must seek or stop at an offset.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.envelope import ENVELOPE, no_headers, seek, watermarks
from millrace.functions.session import ship

#: Offsets that a task of the Python source reads, and rows that it turns into Python objects at once.
OFFSETS_PER_TASK, READ_ROWS = 1_000_000, 4_096


class TopicExists(ValueError):
    """The topic is there already."""


class TopicDoesNotExist(ValueError):
    """There is no such topic."""


class PartitionDoesNotExist(ValueError):
    """The topic has fewer partitions."""


class OffsetOutOfRange(ValueError):
    """An offset beyond the end of its partition."""


class LogStore:
    """Topics under a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))  # noqa: SLF001

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def create_topic(self, topic: str, partitions: int) -> None:
        if partitions < 1:
            raise ValueError("a topic has one partition at least")
        if topic in self.list_topics():
            raise TopicExists(topic)
        out = self._files().create(self._path("_topics", f"{topic}.json"))
        out.write(bytearray(json.dumps({"partitions": partitions}).encode()))
        out.close()

    def list_topics(self) -> list[str]:
        files, folder = self._files(), self._path("_topics")
        if not files.exists(folder):
            return []
        return sorted(s.getPath().getName().removesuffix(".json") for s in files.listStatus(folder))

    def delete_topic(self, topic: str) -> None:
        self.partition_count(topic)
        self._files().delete(self._path("_topics", f"{topic}.json"), False)
        self._files().delete(self._path("data", f"topic={topic}"), True)

    def partition_count(self, topic: str) -> int:
        if topic not in self.list_topics():
            raise TopicDoesNotExist(topic)
        return int(json.loads(self.spark.read.text(f"{self.root}/_topics/{topic}.json", wholetext=True).first()[0])["partitions"])

    def read(self, topic: str | list[str], start: dict[int, int] | None = None, end: dict[int, int] | None = None) -> DataFrame:
        """The rows of one or several topics, from start offsets (the first by default) up to (not including) end offsets."""
        topics = [topic] if isinstance(topic, str) else topic
        for t in topics:
            self.partition_count(t)
        if not self._files().exists(self._path("data")):
            return self.spark.createDataFrame([], ENVELOPE)
        log = self.spark.read.schema(ENVELOPE).parquet(f"{self.root}/data").select(*ENVELOPE.names).filter(F.col("topic").isin(topics))
        if start is None and end is None:
            return log
        # partitions that aren't named are read whole
        every = range(max(self.partition_count(t) for t in topics))
        if any(p not in every for p in (*(start or {}), *(end or {}))):
            raise PartitionDoesNotExist(f"{topics}: {sorted({*(start or {}), *(end or {})})}")
        return seek(log, {p: ((start or {}).get(p, 0), (end or {}).get(p)) for p in every})

    def read_stream(self, topic: str, max_files: int | None = None) -> DataFrame:
        """New rows of a topic as they are written; ``max_files`` bounds a micro-batch."""
        reader = self.spark.readStream.schema(ENVELOPE)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        return reader.parquet(f"{self.root}/data").select(*ENVELOPE.names).filter(F.col("topic") == topic)

    def watermarks(self, topic: str) -> dict[int, tuple[int, int]]:
        """(low, high) of every partition; an empty one has (0, 0)."""
        found = {r.partition: (r.low, r.high) for r in watermarks(self.read(topic)).collect()}
        return {p: found.get(p, (0, 0)) for p in range(self.partition_count(topic))}

    def consume(self, topic: str, partition: int, offset: int) -> object | None:
        """The row at an offset; None at the end of the partition."""
        if offset < 0:
            raise ValueError("negative offset")
        if partition not in range(self.partition_count(topic)):
            raise PartitionDoesNotExist(f"{topic}/{partition}")
        row = seek(self.read(topic), {partition: (offset, offset + 1)}).first()
        if row is None and offset > self.watermarks(topic)[partition][1]:
            raise OffsetOutOfRange(f"{topic}/{partition} {offset}")
        return row

    def produce(self, rows: DataFrame, topic: str, order_by: list[str] | None = None, timestamp: Column | None = None) -> None:
        """Append rows (key, value, optionally headers, partition, timestamp). A row without a partition goes to one by
        its key's hash, or its value's. Offsets go on from the partition's end in ``order_by`` order."""
        count = self.partition_count(topic)
        columns = rows.columns
        hashed = F.pmod(F.xxhash64(F.coalesce(*[c for c in ("key", "value") if c in columns])), F.lit(count)).cast("int")
        given = F.coalesce(F.col("partition").cast("int"), hashed) if "partition" in columns else hashed
        bad = F.raise_error(F.format_string("no partition %d", "partition")).cast("int")
        placed = rows.withColumn("partition", given).withColumn("partition", F.when(F.col("partition").between(0, count - 1), F.col("partition")).otherwise(bad))
        for name, default in (("key", F.lit(None).cast("binary")), ("headers", no_headers()), ("timestamp", timestamp if timestamp is not None else F.current_timestamp())):
            if name not in columns:
                placed = placed.withColumn(name, default)
        ends = self.spark.createDataFrame([(p, high) for p, (_, high) in self.watermarks(topic).items()], "partition int, __end bigint")
        order = [F.col(c) for c in order_by] if order_by else [F.monotonically_increasing_id()]
        number = F.row_number().over(Window.partitionBy("partition").orderBy(*order)) - 1
        out = placed.withColumn("offset", number).join(F.broadcast(ends), "partition").withColumn("offset", (F.col("offset") + F.col("__end")).cast("long"))
        out = out.withColumn("topic", F.lit(topic)).select(*[F.col(f.name).cast(f.dataType) for f in ENVELOPE.fields])
        self.append(out)

    def append(self, log: DataFrame) -> None:
        """Append rows that have their offsets already."""
        log.write.mode("append").partitionBy("topic", "partition").parquet(f"{self.root}/data")


class _Range(InputPartition):
    def __init__(self, partition: int, start: int, end: int) -> None:
        super().__init__(partition)
        self.partition, self.start, self.end = partition, start, end


def _split(ranges: list[_Range], options: dict) -> list[_Range]:
    """Ranges of at most ``offsetsPerTask`` offsets, so that a long log partition is read by many tasks."""
    step = int(options.get("offsetspertask", OFFSETS_PER_TASK))
    if step < 1:
        raise ValueError("offsetsPerTask must be positive")
    return [_Range(r.partition, a, min(a + step, r.end)) for r in ranges for a in range(r.start, r.end, step)]


#: Row groups of files that were looked at before: files don't change once they are written.
_known: dict[str, list[tuple[int, int, int]]] = {}


def _row_groups(folder: str) -> list[tuple[int, int, str, int]]:
    """(least offset, greatest offset, file, row group) of a log partition's files by offset, from their footers."""
    import os

    import pyarrow.parquet as pq

    names = [n for n in os.listdir(folder) if n.endswith(".parquet") and n[0] not in "._"] if os.path.isdir(folder) else []
    out = []
    for path in (os.path.join(folder, n) for n in names):
        if path not in _known:
            with pq.ParquetFile(path) as file:
                about, groups = file.metadata, []
                leaf = next(k for k in range(about.num_columns) if about.schema.column(k).path == "offset")
                for g in range(about.num_row_groups):
                    stats = about.row_group(g).column(leaf).statistics
                    if about.row_group(g).num_rows == 0:
                        continue
                    if stats is not None and stats.has_min_max:
                        groups.append((stats.min, stats.max, g))
                    else:
                        offsets = file.read_row_group(g, columns=["offset"])["offset"].to_numpy()
                        groups.append((int(offsets.min()), int(offsets.max()), g))
            _known[path] = groups
        out += [(low, high, path, g) for low, high, g in _known[path]]
    return sorted(out)


def _folder(path: str, topic: str, partition: int) -> str:
    return f"{path.removeprefix('file://')}/data/topic={topic}/partition={partition}"


def _rows(path: str, topic: str, part: _Range):
    """Rows of one partition's files, by offset. Files are read here in Python, so the path must be mounted. Row groups are
    read one after the other; only those whose offsets overlap are held, and sorted, together."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    wanted = [g for g in _row_groups(_folder(path, topic, part.partition)) if g[0] < part.end and g[1] >= part.start]
    at = 0
    while at < len(wanted):
        after, high = at + 1, wanted[at][1]
        while after < len(wanted) and wanted[after][0] <= high:
            high, after = max(high, wanted[after][1]), after + 1
        tables = []
        for _, _, file, group in wanted[at:after]:
            with pq.ParquetFile(file) as opened:
                table = opened.read_row_group(group)
            tables.append(table.filter(pc.and_(pc.greater_equal(table["offset"], part.start), pc.less(table["offset"], part.end))))
        at = after
        for batch in pa.concat_tables(tables).sort_by("offset").to_batches(READ_ROWS):
            for row in batch.to_pylist():
                headers = [(h["key"], h["value"]) for h in row["headers"] or ()]
                time = row["timestamp"]
                if time is not None:
                    time = pd.Timestamp(time)
                    time = (time.tz_localize("UTC") if time.tzinfo is None else time).to_pydatetime(warn=False)
                yield (topic, part.partition, row["offset"], time, row["key"], row["value"], headers)


def _ends(path: str, topic: str) -> dict[str, int]:
    """The next offset of every partition, from the files' footers: no offsets are read."""
    with open(f"{path.removeprefix('file://')}/_topics/{topic}.json", encoding="utf-8") as file:
        count = json.load(file)["partitions"]
    return {str(p): max((high + 1 for _, high, _, _ in _row_groups(_folder(path, topic, p))), default=0) for p in range(count)}


class LogDataSource(DataSource):
    """``format("millrace_log")``, options path, topic, startingOffsets and endingOffsets (earliest, latest or JSON by
    partition), maxOffsetsPerTrigger, offsetsPerTask and committed (a file that gets every finished end offset). Tasks read
    ranges of offsets and give their rows in order."""

    @classmethod
    def name(cls) -> str:
        return "millrace_log"

    def schema(self) -> StructType:
        return ENVELOPE

    def reader(self, schema: StructType) -> DataSourceReader:
        return _LogReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _LogStreamReader(self.options)


def _chosen(option: str | None, ends: dict[str, int], default: str) -> dict[str, int]:
    option = option or default
    if option == "earliest":
        return dict.fromkeys(ends, 0)
    if option == "latest":
        return dict(ends)
    given = json.loads(option)
    out = dict.fromkeys(ends, 0) if default == "earliest" else dict(ends)
    for p, o in given.items():
        if p not in ends:
            raise PartitionDoesNotExist(p)
        if o < 0:
            raise ValueError("negative offset")
        if o > ends[p]:
            raise OffsetOutOfRange(f"partition {p} offset {o}")
        out[p] = o
    return out


class _LogReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.topic, self.options = options["path"], options["topic"], {k.lower(): v for k, v in dict(options).items()}

    def partitions(self):
        ends = _ends(self.path, self.topic)
        start = _chosen(self.options.get("startingoffsets"), ends, "earliest")
        end = _chosen(self.options.get("endingoffsets"), ends, "latest")
        return _split([_Range(int(p), start[p], end[p]) for p in ends], self.options) or [_Range(0, 0, 0)]

    def read(self, partition):
        return _rows(self.path, self.topic, partition)


class _LogStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path, self.topic, self.options = options["path"], options["topic"], {k.lower(): v for k, v in dict(options).items()}
        self.most = int(self.options.get("maxoffsetspertrigger", 0))
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return _chosen(self.options.get("startingoffsets"), _ends(self.path, self.topic), "earliest")

    def latestOffset(self) -> dict:  # noqa: N802
        ends = _ends(self.path, self.topic)
        if not self.most:
            return ends
        if self.at is None:
            self.at = self.initialOffset()
        left, out = self.most, {}
        for p in sorted(ends, key=int):
            step = min(left, max(0, ends[p] - self.at.get(p, 0)))
            out[p] = self.at.get(p, 0) + step
            left -= step
        self.at = out
        return out

    def partitions(self, start: dict, end: dict):
        self.at = dict(end)
        return _split([_Range(int(p), start.get(p, 0), o) for p, o in end.items()], self.options)

    def read(self, partition):
        return _rows(self.path, self.topic, partition)

    def commit(self, end: dict) -> None:
        """Called after a batch, perhaps twice for the same end: writing the same offsets again changes nothing."""
        target = self.options.get("committed")
        if target:
            with open(target, "w", encoding="utf-8") as file:
                json.dump(end, file)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(LogDataSource)
