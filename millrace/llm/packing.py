"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

Each document's ids (with one end id) are cut into full windows, which need no search, and a remainder, which is cut
into small pieces. A task collects the pieces until they fill ``group`` windows, then splits them into that many
near-equal windows: partial partitions are merged largest difference first, large sums against small ones. When the
fullest window would exceed the capacity, the window count rises by one and the split is repeated. Grouping happens
within a task, so nothing is shuffled, memory is bounded, and no key can be hot.

Rows: a null or empty text is the end id alone. Repeated rows are packed as rows of their own, null doc_ids stay null,
an empty table gives an empty one, and extra columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from millrace.llm.common import released, ship

CAPACITY = 1024
#: Remainders are cut into pieces of at most this many ids, so that windows can be made near-equal.
PIECE = 256
#: Windows that one differencing run fills.
GROUP = 256


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Indexes of ``sizes`` in ``windows`` sets with near-equal sums (largest differencing method)."""
    if windows == 1:
        return [list(range(len(sizes)))]
    # a partial partition: window sums with their members, largest first; windows that are empty are left out
    heap: list = [(-s, i, [(s, i, (i, None, None))]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, first = heapq.heappop(heap)
        _, _, second = heapq.heappop(heap)
        over = len(first) + len(second) - windows
        if over > 0:
            # the `over` smallest of each, opposed: the largest of one meets the smallest of the other
            if len(first) < len(second):
                first, second = second, first
            free = len(first) - over
            joined = first[:free] + second[: len(second) - over]
            for x, y in zip(first[free:], reversed(second[len(second) - over :]), strict=True):
                serial += 1
                joined.append((x[0] + y[0], serial, (None, x[2], y[2])))
        else:
            joined = first + second
        joined.sort(key=lambda w: (-w[0], w[1]))
        least = joined[-1][0] if len(joined) == windows else 0
        serial += 1
        heapq.heappush(heap, (least - joined[0][0], serial, joined))
    out: list[list[int]] = []
    for _, _, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            leaf, a, b = stack.pop()
            if a is None:
                members.append(leaf)
            else:
                stack += (a, b)
        out.append(sorted(members))
    return out + [[] for _ in range(windows - len(out))]


def pack_sizes(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Near-equal windows of at most ``capacity``, as few as differencing manages."""
    if not sizes:
        return []
    if max(sizes) > capacity:
        raise ValueError("a piece exceeds the capacity")
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        out = differencing(sizes, windows)
        if max(sum(sizes[i] for i in own) for own in out) <= capacity:
            return [own for own in out if own]
        windows += 1


class Tokens:
    """Ids of the byte-level tokenizer file. The same vocabulary's faster library encodes texts of plain Latin letters,
    where both agree; other texts go through the file's own library."""

    def __init__(self, name: str, ranks: str | None) -> None:
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
        self.fast = None
        if ranks:
            import tiktoken

            with open(ranks if "/" in ranks else public_tokenizers.path(ranks), "rb") as file:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
            self.fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.special = sorted(t.content for t in self.library.get_added_tokens_decoder().values())

    def encode(self, text: str) -> list[int]:
        if self.fast and max(text, default="") < "ɐ" and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


_tokens: dict[tuple, Tokens] = {}


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end_id: int = 0, capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, the ids
    as little-endian unsigned 32-bit numbers. Sequence ids are unique; their high bits are the task's partition."""
    ship(docs.sparkSession)
    source = docs.select("doc_id", "text")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, ranks)
        if key not in _tokens:
            _tokens[key] = Tokens(tokenizer, ranks)
        own = _tokens[key]
        sequence = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        waiting: list[tuple] = []
        held = 0

        def fill(pieces: list[tuple]) -> Iterator[tuple]:
            nonlocal sequence
            for members in pack_sizes([p[2] for p in pieces], capacity):
                offset = 0
                for i in members:
                    p = pieces[i]
                    yield (*p[:5], sequence, offset, *p[5:])
                    offset += p[2]
                sequence += 1

        def emit() -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.array([*(own.encode(text) if text else ()), end_id], "<u4")
                n, full = len(ids), len(ids) // capacity * capacity
                step = -(-(n - full) // -(-(n - full) // piece)) if n > full else 1
                for start in [*range(0, full, capacity), *range(full, n, step)]:
                    raw = ids[start : min(n, start + (capacity if start < full else step))].tobytes()
                    cut = (doc_id, start, len(raw) // 4, zlib.crc32(raw), n, *([raw] * with_ids))
                    if start < full:
                        rows.append((*cut[:5], sequence, 0, *cut[5:]))
                        sequence += 1
                    else:
                        waiting.append(cut)
                        held += cut[2]
                if held >= group * capacity:
                    rows += fill(waiting)
                    waiting, held = [], 0
                if len(rows) >= 8192:
                    yield emit()
        rows += fill(waiting)
        if rows:
            yield emit()

    return source.mapInArrow(lambda batches: released(run(batches)), schema)
