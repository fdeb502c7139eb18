"""Media columns: texts as 8-bit images in a content-defined, deduplicated chunk store.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are the samples of a binary greyscale image
(PGM) of width 64. Stored images are cut where a rolling gear hash of the last 32 bytes hits a mask, so equal passages
give equal chunks wherever they stand. Spark joins decide which image keeps a chunk that several hold; the store has an
ordered chunk list by distinct image, with the bytes of the chunks that it keeps. Reading back joins lent chunks to the
lists that lack them, verifies every image by its digest, and computes features from the samples read.

Rows: a null text counts as empty. Equal texts share one stored image, whatever their doc_ids (null ones too); repeated
rows give equal rows; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship

WIDTH = 64
#: Least, mean (a power of two) and largest bytes of a chunk.
LEAST, MEAN, MOST = 256, 1024, 8192
#: Decisions on rows and chunks are broadcast up to this many (about 40 bytes each), else joined by shuffle.
BROADCAST_ROWS = 400_000

_GEAR = np.random.default_rng(64).integers(0, 1 << 32, 256, dtype=np.uint32)
_MASK = np.uint32((MEAN - 1) << (32 - (MEAN.bit_length() - 1)))


def to_media(raw: bytes) -> bytes:
    padded = raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))
    return b"P5\n%d %d\n255\n" % (WIDTH, len(padded) // WIDTH) + padded


def payload_of(media: bytes) -> bytes:
    head = media.split(b"\n", 3)
    if head[0] != b"P5" or len(head) < 4:
        raise ValueError("not a greyscale image")
    return media[len(media) - len(head[3]) :]


def cuts(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of 32 bytes hits the mask."""
    with np.errstate(over="ignore"):
        h = _GEAR[data]
        for n in (1, 2, 4, 8, 16):
            h[n:] = h[n:] + (h[:-n] << np.uint32(n))
    return np.flatnonzero((h & _MASK) == 0) + 1


def chunk_ends(sizes: list[int], data: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of the images that lie one after another in ``data``."""
    places = cuts(data)
    out, start = [], 0
    for size in sizes:
        ends, last = [], 0
        for c in (places[np.searchsorted(places, start) : np.searchsorted(places, start + size)] - start).tolist():
            while c - last > MOST:
                last += MOST
                ends.append(last)
            if c - last >= LEAST:
                ends.append(c)
                last = c
        while size - last > MOST:
            last += MOST
            ends.append(last)
        if last < size:
            ends.append(size)
        out.append(ends)
        start += size
    return out


def _media_chunks(texts: list[str | None]) -> Iterator[tuple[bytes, bytes, list[bytes]]]:
    """(text bytes, image, its chunks) by text, in groups of about 1 MB."""
    at = 0
    while at < len(texts):
        raws, media, held = [], [], 0
        while at < len(texts) and held < 1 << 20:
            raws.append((texts[at] or "").encode("utf-8", "surrogatepass"))
            media.append(to_media(raws[-1]))
            held += len(media[-1])
            at += 1
        for raw, own, ends in zip(raws, media, chunk_ends([len(m) for m in media], np.frombuffer(b"".join(media), np.uint8)), strict=True):
            yield raw, own, [own[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def chunk_lists(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_bytes, media_sha (binary) and the chunks' digests in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(raw), hashlib.sha256(own).digest(), [_digest(c) for c in chunks]) for raw, own, chunks in _media_chunks(batch.column(2).to_pylist())]
            n, sha, digests = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(digests, pa.list_(pa.binary()))], ["doc_id", "text_hash", "n_bytes", "media_sha", "digests"])

    return docs.select("doc_id", _text_hash(), "text").mapInArrow(run, "doc_id bigint, text_hash bigint, n_bytes bigint, media_sha binary, digests array<binary>")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")


def _bounded(frame: DataFrame, most: int, items: Column | None = None) -> DataFrame:
    """For broadcast if the frame has at most so many rows, or items of an array column with the rows."""
    counted = frame if items is None else frame.select(F.explode_outer(items))
    return F.broadcast(frame) if counted.limit(most + 1).count() <= most else frame


def store(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(lists, chunk store): lists have doc_id, n_bytes, n_media, media_sha; the store one row by distinct image with
    media_sha, n_bytes and chunks (digest, data; null data where another image keeps it; lent: others lack it)."""
    ship(docs.sparkSession)
    lists = scratch.cut(chunk_lists(docs))
    key = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    owners = scratch.cut(lists.groupBy("media_sha", "digests").agg(F.min(key).alias("media_id"), F.count("*").alias("copies")))
    held = owners.select("media_id", F.explode(F.array_distinct("digests")).alias("digest"))
    homes = held.groupBy("digest").agg(F.min("media_id").alias("home"), F.max("media_id").alias("last")).filter("home <> last").select("digest", "home")
    shared = held.join(homes, "digest").select("media_id", "digest", (F.col("media_id") == F.col("home")).alias("kept"))
    marks = shared.groupBy("media_id").agg(F.collect_list(F.when(F.col("kept"), F.col("digest"))).alias("lent"), F.collect_list(F.when(~F.col("kept"), F.col("digest"))).alias("foreign"))
    # a row whose text another doc_id owns is skipped, not the other texts that may share its own doc_id
    copies = lists.join(owners.filter("copies > 1").select("media_sha", "media_id"), "media_sha").filter(key != F.col("media_id")).select(key.alias("media_id"), "text_hash").distinct()
    copies = scratch.cut(copies.withColumn("skip", F.lit(True)))
    marks = scratch.cut(marks)
    met = docs.select(key.alias("media_id"), _text_hash(), "text").join(_bounded(copies, BROADCAST_ROWS), ["media_id", "text_hash"], "left").join(_bounded(marks, BROADCAST_ROWS, F.concat("lent", "foreign")), "media_id", "left").select("text", "skip", "lent", "foreign")
    repeats = lists.groupBy("doc_id", "media_sha").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.filter(pa.compute.invert(pa.compute.fill_null(batch.column(1), False)))
            rows = []
            marked = zip(keep.column(2).to_pylist(), keep.column(3).to_pylist(), strict=True)
            for (raw, own, chunks), (lent, foreign) in zip(_media_chunks(keep.column(0).to_pylist()), marked, strict=True):
                lent, seen, out = set(lent or ()), set(foreign or ()), []
                for c in chunks:
                    d = _digest(c)
                    out.append({"digest": d, "data": None if d in seen else c, "lent": d in lent and d not in seen})
                    seen.add(d)
                rows.append((hashlib.sha256(own).digest(), len(raw), out))
            if rows:
                kind = pa.list_(pa.struct([("digest", pa.binary()), ("data", pa.binary()), ("lent", pa.bool_())]))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), kind), strict=True)], ["media_sha", "n_bytes", "chunks"])

    written = met.mapInArrow(run, "media_sha binary, n_bytes bigint, chunks array<struct<digest: binary, data: binary, lent: boolean>>")
    # rows that repeat a doc_id and its text would store its image twice
    return lists, scratch.cut(written.dropDuplicates(["media_sha"]) if repeats else written)


def read_back(chunks: DataFrame) -> DataFrame:
    """By distinct image: media_sha, payload_bytes, payload_sha256, tail_crc32, media_bytes, feature; verified."""
    lacks = F.exists("chunks", lambda c: c["data"].isNull())
    whole, partial = chunks.filter(~lacks).withColumn("lent", F.lit(None).cast("array<struct<digest: binary, data: binary>>")), chunks.filter(lacks)
    need = partial.select("media_sha", F.explode("chunks").alias("c")).filter("c.data IS NULL").select("media_sha", "c.digest").distinct()
    lent = chunks.filter(F.exists("chunks", lambda c: c["lent"])).select(F.explode("chunks").alias("c")).filter("c.lent").select("c.digest", "c.data")
    # images that only repeat an own chunk need no loan
    loans = need.join(lent, "digest").groupBy("media_sha").agg(F.collect_list(F.struct("digest", "data")).alias("lent"))
    every = whole.unionByName(partial.join(loans, "media_sha", "left")).select("media_sha", "chunks", "lent")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                sha, parts, loans = (batch.column(c)[at].as_py() for c in range(3))
                known = {x["digest"]: x["data"] for x in [*(loans or ()), *parts] if x["data"] is not None}
                media = b"".join([known[x["digest"]] for x in parts])
                if hashlib.sha256(media).digest() != sha:
                    raise ValueError("a stored image doesn't have its digest")
                payload = payload_of(media)
                samples = np.frombuffer(payload, np.uint8)
                bins = np.bincount(samples >> 5, minlength=8)
                feature = f"{WIDTH}x{len(samples) // WIDTH} mean={samples.mean():.6f} deviation={samples.std():.6f} bins=" + "/".join(map(str, bins.tolist()))
                rows.append((sha, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), feature))
            kinds = (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            columns = zip(*rows, strict=True) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["media_sha", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "feature"])

    return every.mapInArrow(run, "media_sha binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, feature string")


def media_report(docs: DataFrame) -> DataFrame:
    """By document: its sizes, the digests of the payload and the image as read back from the store, and the feature."""
    scratch = Scratch(docs.sparkSession, "media")
    lists, chunks = store(docs, scratch)
    read = scratch.cut(read_back(chunks))
    return lists.select("doc_id", "n_bytes", "media_sha").join(read, "media_sha").select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media_sha")).alias("media_sha256"), "feature")
