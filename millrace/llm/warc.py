"""WARC archives of pages: writing with revisit records, reading back, and an external merge of capture indexes.

Writing: payload digests are grouped first; of equal payloads of at least ``REVISIT_BYTES`` the least page_id's record
is the response, and the others are revisits that refer to it. A task writes its records into segments of about
``SEGMENT`` bytes; a segment is a binary column of a Parquet table in the shared folder, so any store can hold it, and
``export`` turns segments into files. Reading parses segments and gives a locally sorted capture run for each, which is
written. Ranges of URL key, timestamp and page_id (a hot key spreads over ranges) cut every run into sorted slices; a
range's slices are merged by a loser tree, which reads each of them in order and nothing twice, and the ranges follow one
another, which puts all capture histories in global order. No row is sorted again after its run.

Rows: a null html is an empty payload; a null url has the key "". Null page_ids come last of equal payloads; if all are
null, all are responses. Rows that repeat the least page_id with its payload are all responses. An empty table gives an
empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship, whole_groups

REVISIT_BYTES, SEGMENT, BROADCAST_ROWS = 100, 4 << 20, 200_000
#: Pages carry no capture time; by default page n counts as captured n seconds after this one.
FIRST_CAPTURE = datetime(2024, 1, 1, tzinfo=timezone.utc)

RUN = "url_key string, timestamp string, page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, segment string, start bigint, length bigint"
_NAMES = [x.split()[0] for x in RUN.split(", ")]


def url_key(url: str | None) -> str:
    """Host labels reversed, then path and query, in lower case: com,example)/path?query. What isn't a URL is its own key."""
    try:
        parts = urlsplit((url or "").strip().lower())
    except ValueError:
        return (url or "").strip().lower()
    host = re.sub(r"^www\d*\.", "", parts.netloc.rpartition("@")[2].partition(":")[0])
    if not host:
        return (url or "").strip().lower()
    return ",".join(reversed(host.split("."))) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def capture_time(page_id: int | None) -> str:
    try:
        return (FIRST_CAPTURE + timedelta(seconds=page_id or 0)).strftime("%Y-%m-%dT%H:%M:%SZ")
    except OverflowError:
        return "9999-12-31T23:59:59Z"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record; a revisit (refers_to given) has no payload."""
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {capture_time(page_id)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha256:{base64.b32encode(bytes.fromhex(digest)).decode()}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, length, headers, block) of the records of a segment."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
        stop = end + 4 + int(headers["content-length"])
        yield at, stop + 4 - at, headers, data[end + 4 : stop]
        at = stop + 4


def capture(headers: dict[str, str], block: bytes, start: int, length: int, segment: str) -> tuple:
    """A row of a capture run. A response's payload is checked against its digest."""
    page = headers["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
    refers = headers.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
    digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha256:")).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    if headers["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a record's payload doesn't have its digest")
    url = headers["warc-target-uri"]
    return (url_key(url), headers["warc-date"], int(page) if page else None, size, digest, headers["warc-type"], int(refers) if refers else None, url, segment, start, length)


def write(pages: DataFrame, scratch: Scratch, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """The written segments: segment (name) and data."""
    ship(pages.sparkSession)
    source = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    first = source.filter(F.octet_length("html") >= revisit_bytes).select(digest.alias("digest"), "page_id").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = scratch.cut(first.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    small = first.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = source.withColumn("digest", digest).join(F.broadcast(first) if small else first, "digest", "left")
    met = met.select("page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def segment() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{count:06d}"]), pa.array([b"".join(held)], pa.binary())], ["segment", "data"])

        for batch in batches:
            for at in range(batch.num_rows):
                page, url, html, digest, refers = (c[at].as_py() for c in batch.columns)
                held.append(record(page, url, html.encode("utf-8", "surrogatepass"), refers, digest))
                size += len(held[-1])
                if size >= SEGMENT:
                    yield segment()
                    held, size, count = [], 0, count + 1
        if held:
            yield segment()

    return scratch.cut(met.mapInArrow(run, "segment string, data binary"))


def capture_runs(segments: DataFrame) -> DataFrame:
    """Read the archives: each segment's captures, sorted by URL key, timestamp and page_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch.column(0)[at].as_py()
                rows = [capture(h, block, start, length, name) for start, length, h, block in parse(batch.column(1)[at].as_py())]
                rows.sort(key=_order)
                yield _rows(rows)

    return segments.mapInArrow(run, RUN)


def _order(row: tuple) -> tuple:
    return row[0], row[1], row[2] is None, row[2] or 0, row[8], row[9]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    text = pa.string()
    kinds = [text, text, pa.int64(), pa.int64(), text, text, pa.int64(), text, text, pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], _NAMES)


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of their match, so each next row costs one path of comparisons."""

    def __init__(self, runs: list[Iterable], key: Callable) -> None:
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.size = max(1, len(runs))
        self.heads: list = [self._next(i) for i in range(len(runs))] or [None]
        self.losers = [-1] * self.size
        self.winner = -1
        for i in range(self.size):
            self._enter(i)

    def _next(self, i: int) -> tuple | None:
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), row)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _enter(self, i: int) -> None:
        """Play run i up the tree; while the tree fills, it waits at the first free node."""
        node = (i + self.size) // 2
        while node:
            if self.losers[node] < 0:
                self.losers[node] = i
                return
            if self._beats(self.losers[node], i):
                self.losers[node], i = i, self.losers[node]
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator:
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner][1]
            at = self.winner
            self.heads[at] = self._next(at)
            self._enter(at)


def merge_runs(runs: DataFrame, scratch: Scratch, rows_per_range: int = 200_000) -> DataFrame:
    """All captures in global order of URL key, timestamp and page_id."""
    runs = scratch.cut(runs)
    ranges = max(-(-runs.count() // rows_per_range), runs.sparkSession.sparkContext.defaultParallelism)
    place = [F.col("url_key"), F.col("timestamp"), F.col("page_id").isNull().alias("none"), F.coalesce("page_id", F.lit(0)).alias("page"), F.col("segment"), F.col("start")]
    dealt = runs.select(*place).repartitionByRange(ranges, "url_key", "timestamp", "none", "page", "segment", "start")
    firsts = dealt.groupBy(F.spark_partition_id().alias("range")).agg(F.min(F.struct(*dealt.columns)).alias("first"))
    # one row for each range
    bounds = sorted(tuple(r.first) for r in firsts.select("first").collect())[1:]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [_order(row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            own = [(key[4], bisect.bisect_right(bounds, key)) for key in keys]
            edges = [i for i in range(len(own)) if i == 0 or own[i] != own[i - 1] or keys[i] < keys[i - 1]] + [len(own)]
            slices = [_packed(batch.slice(a, b - a)) for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([own[a][1] for a in edges[:-1]], pa.int64()), pa.array([own[a][0] for a in edges[:-1]], pa.string()), pa.array(slices, pa.binary())], ["range", "segment", "slice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in whole_groups(batches, ["range"]):
            for own in _by_range(group):
                held = []
                for row in LoserTree([_unpacked(x.as_buffer()) for x in own.column("slice")], _order):
                    held.append(row)
                    if len(held) == 8192:
                        yield _rows(held)
                        held = []
                yield _rows(held)

    slices = runs.select(*_NAMES).mapInArrow(cut, "range bigint, segment string, slice binary")
    return slices.repartitionByRange(ranges, "range").sortWithinPartitions("range", "segment").mapInArrow(merge, RUN)


def _by_range(group: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    names = group.column("range").to_pylist()
    edges = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
    return (group.slice(a, b - a) for a, b in zip(edges, edges[1:], strict=False))


def _packed(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for at in range(0, rows.num_rows, 1024):
            out.write_batch(rows.slice(at, 1024))
    return sink.getvalue().to_pybytes()


def _unpacked(data: pa.Buffer) -> Iterator[tuple]:
    """The rows of a slice, a block at a time."""
    for block in pa.ipc.open_stream(data):
        yield from zip(*(c.to_pylist() for c in block.columns), strict=True)


def export(segments: DataFrame, folder: str) -> list[str]:
    """Write the segments as .warc files into a folder that the driver can reach, one at a time."""
    os.makedirs(folder, exist_ok=True)
    paths = []
    for row in segments.toLocalIterator():
        paths.append(os.path.join(folder, f"{row.segment}.warc"))
        with open(paths[-1], "wb") as file:
            file.write(row.data)
    return paths


def archive_report(pages: DataFrame) -> DataFrame:
    """By page, in the order of the capture histories: what the archives hold of it."""
    scratch = Scratch(pages.sparkSession, "warc")
    merged = merge_runs(capture_runs(write(pages, scratch)), scratch)
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
