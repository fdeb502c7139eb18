"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

Documents are sets of word shingles. Equal sets become one class first, so copies cost one row. Each class has a sketch
of minwise tokens; token k of two sets agrees with the probability of their Jaccard similarity. In every one of several
independent trees a node picks one or two token places (1/similarity on average), and its documents go to the child of
their token there. Nodes of at most ``LEAF`` documents are compared exhaustively: by sketch on the first level, on full
sets below. In larger nodes each document is compared with a center and branches on; what is left at the depth limit is
compared in two random divisions into blocks of about ``LEAF``, and at the end, where its documents are in more than one
group, block against block on full sets: all pairs of different groups. Pairs that the sketches don't rule out are confirmed on
the full shingle sets: first each document's best pair, then all pairs that still join two groups, then pairs that a
likelier one made needless in a leaf but whose documents confirmed links have not joined. Confirmed pairs go through
union-find.

A link survives a tree's level with probability similarity x branching, about 1, so ``TREES`` trees find a pair at the
threshold with a probability over 0.999. Nodes are keys of narrow rows (path, id); no group is ever held as a whole.

Rows: a null, empty or blank text has no shingles and links with nothing. A null doc_id gets its count, a null
component and kept = true. Rows that share a doc_id count as one document with all their links. An empty table gives an
empty one; extra columns are ignored. Long texts are hashed in pieces; a document needs memory of 8 bytes a word for its
set of shingles wherever it is confirmed, and some ten times that while the set is made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, ship, whole_groups
from millrace.llm.graph import components, cross_blocks

#: Minwise tokens of a sketch, trees, deepest level, largest node that is compared exhaustively.
TOKENS, TREES, DEPTH, LEAF = 64, 8, 4, 48
#: Members of a large node, and their shingles, that are compared at once with as many others; columns of their table.
CROSS, CROSS_SHINGLES, COLUMNS = 256, 1 << 19, 1 << 15
#: Most ids of documents to confirm that are broadcast.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose words are hashed together.
CHUNK = 1 << 18

_MASK = (1 << 64) - 1


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64-bit hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 2 + 1))


_BASE = 0x9FB21C651E98DF25
_LETTER = _numbers(256, 1)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SALTS = _numbers(TOKENS, 3)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64; kept up to two chunks' length."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n if n > 2 * CHUNK else 2 * CHUNK, np.uint64(base))
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= 2 * CHUNK:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each word of the texts in ``data`` begins, its 64-bit hash, and each text's first word (one more at the end).

    ``data`` are UTF-8 bytes, text i being data[offsets[i]:offsets[i + 1]]; A-Z count as a-z. Long data are hashed in
    pieces that end at a blank, so that only a longer word needs more memory.
    """
    size = len(data)
    if not size:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    if size > 2 * CHUNK:
        starts, words, at = [], [], 0
        while at < size:
            end = look = min(at + CHUNK, size)
            while look < size and not (found := np.flatnonzero(_SPACE[data[look : look + CHUNK]])).size:
                look += CHUNK
            end = end if end == size else look + int(found[0]) if look < size else size
            if end - at > 2 * CHUNK:  # one long word
                own = _hash_words(data[at:end], np.unique(np.clip(offsets, at, end)) - at)
            else:
                own = word_hashes(data[at:end], np.unique(np.clip(offsets, at, end)) - at)[:2]
            starts.append(own[0] + at)
            words.append(own[1])
            at = end
        first = np.concatenate(starts)
        return first, np.concatenate(words), np.searchsorted(first, offsets)
    starts, words = _hash_words(data, offsets)
    return starts, words, np.searchsorted(starts, offsets)


def _hash_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(data)
    with np.errstate(over="ignore"):
        letter = ~_SPACE[data]
        first = np.zeros(size + 1, bool)
        first[offsets] = True
        before = np.r_[False, letter[:-1]] & ~first[:-1]
        after = np.r_[letter[1:], False] & ~first[1:]
        starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after)
        power, inverse = _power_tables(size)
        sums = np.cumsum(_LETTER[data] * power)
        word = sums[ends]
        word[starts > 0] -= sums[starts[starts > 0] - 1]
        return starts, _mix(word * inverse[starts])


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles of the texts in ``data``, and where each text's begin (one more at the end)."""
    _, word, at = word_hashes(data, offsets)
    with np.errstate(over="ignore"):
        own = np.diff(at)
        many = np.maximum(own - words + 1, np.minimum(own, 1))
        begins = np.r_[0, np.cumsum(many)]
        start = np.repeat(at[:-1] - begins[:-1], many) + np.arange(begins[-1])
        length = np.repeat(np.minimum(own, words), many)
        hashes = length.astype(np.uint64)
        for k in range(words if len(word) else 0):
            inside = k < length
            hashes = np.where(inside, hashes * np.uint64(_BASE) + word[np.minimum(start + k, len(word) - 1)], hashes)
        return _mix(hashes), begins


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of a string column, in chunks of about CHUNK bytes."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        end = min(end, len(column))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for _, _, data, offsets in text_chunks(column):
        hashes, begins = shingle_hashes(data, offsets, words)
        for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            own = np.sort(hashes[a:b])
            yield own[np.r_[True, own[1:] != own[:-1]]] if len(own) else own


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Minwise tokens (rows of TOKENS 32-bit numbers) of non-empty sets: each salt's nearest hash by exclusive or."""
    flat = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    return np.stack([(np.minimum.reduceat(flat ^ salt, starts) >> np.uint64(32)).astype("<u4") for salt in _SALTS], axis=1)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, digest and sketch (null for empty sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = list(shingle_sets(part.column(1), words))
                full = [s for s in sets if len(s)]
                rows = iter(sketches(full)) if full else iter(())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(rows).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "digest", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, sketch binary")


def _children(paths: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Child paths of rows, and each child's row: a node picks its token places by its own hash."""
    extra = _mix(paths ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(1 << 20) < np.uint64(int((1 / similarity - 1) * (1 << 20)))
    out, rows = [], []
    for k, which in enumerate((np.arange(len(paths)), np.flatnonzero(extra))):
        place = _mix(paths[which] + np.uint64(k + 1)) % np.uint64(tokens.shape[1])
        token = tokens[which, place.astype(np.int64)].astype(np.uint64)
        out.append(_mix(_mix(paths[which] ^ (place << np.uint64(40))) + token + np.uint64(1)))
        rows.append(which)
    return np.concatenate(out), np.concatenate(rows)


def _branch(rows: DataFrame, similarity: float, trees: int = 0) -> DataFrame:
    """(path, id) of the children: of ``trees`` roots, or of the rows' own column path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            tokens = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u4").reshape(len(ids), -1)
            with np.errstate(over="ignore"):
                starts = [np.full(len(ids), r) for r in _numbers(trees, 7)] or [batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)]
                for paths in starts:
                    made, which = _children(paths, tokens, similarity)
                    yield pa.RecordBatch.from_arrays([pa.array(made.view(np.int64)), pa.array(ids[which])], ["path", "id"])

    return rows.mapInArrow(run, "path bigint, id bigint")


def _together(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys one after the other, ordered by id; no row holds a group."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, "id")


def _numbers_of(column: pa.Array) -> list[np.ndarray]:
    """The 64-bit numbers that each value of a binary column holds."""
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def _sketches_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def _compare(leaves: DataFrame, least: int, likely: int, hidden: bool = False) -> DataFrame:
    """Pairs (a, b, agree) in leaf nodes with at least ``least`` equal tokens, best first. A pair with ``likely`` equal
    tokens or more joins its documents for the pairs after it, which then needn't come out. With ``hidden`` just those
    come out whose documents are nevertheless in different groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["path", "block"]):
            ids, own, tokens = rows.column("id").to_numpy(), rows.column("group").to_numpy(), _sketches_of(rows.column("sketch"))
            many = np.diff(bounds)
            two = bounds[:-1][many == 2] if not hidden else bounds[:0]
            equal = (tokens[two] == tokens[two + 1]).sum(axis=1)
            left, right, agree = [ids[two[equal >= least]]], [ids[two[equal >= least] + 1]], [equal[equal >= least]]
            for start, size in zip(bounds[:-1][many > 2].tolist(), many[many > 2].tolist(), strict=True):
                part = tokens[start : start + size]
                equal = np.array([(part == row).sum(axis=1) for row in part])
                joined, group = np.arange(size), own[start : start + size]
                pairs = [(-int(equal[i, j]), i, j) for i, j in zip(*np.nonzero(np.triu(equal >= least, 1)), strict=True)]
                chosen = []
                for n, i, j in sorted(pairs):
                    skipped = joined[i] == joined[j]
                    if not skipped and -n >= likely:
                        joined[joined == joined[j]] = joined[i]
                    if skipped == hidden and (not hidden or group[i] != group[j]):
                        chosen.append((start + i, start + j, -n))
                if chosen:
                    i, j, n = np.array(chosen, np.int64).T
                    left.append(ids[i])
                    right.append(ids[j])
                    agree.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(kind)) for x, kind in ((left, np.int64), (right, np.int64), (agree, np.int32))], ["a", "b", "agree"])

    return leaves.mapInArrow(run, "a bigint, b bigint, agree int")


def _leaves(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows of leaf nodes with their members' sketches and groups, node by node."""
    members = rows.join(classes.select("id", "sketch"), "id")
    return _together(members.select("path", "block", "id", "group", "sketch"), "path", "block")


def _agreeing(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b) with at least ``least`` equal tokens, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("x", "y"))
            agree = (x == y).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(agree[agree >= least].astype(np.int32))], ["a", "b", "agree"])

    both = pairs.join(classes.select(F.col("id").alias("b"), F.col("sketch").alias("y")), "b").join(classes.select(F.col("id").alias("a"), F.col("sketch").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, agree int")


def _bounds(similarity: float) -> tuple[int, int]:
    """Equal tokens that rule a pair out below (4.5 deviations), and that make a link likely (1.5 above)."""
    spread = (similarity * (1 - similarity) / TOKENS) ** 0.5
    return int(TOKENS * (similarity - 4.5 * spread)), round(TOKENS * (similarity + 1.5 * spread))


def candidates(classes: DataFrame, scratch: Scratch, similarity: float, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(pairs, first leaves, deep leaves, large nodes). Pairs (a < b, agree) of class ids that a node of the first level or a center
    puts together and the sketches don't rule out, without those that likelier pairs make needless; the rows (path,
    block, id) of first-level leaves of three or more; those of the leaves below large nodes, if there are any; and the
    rows (path, id) of nodes still large at the depth limit, if there are any."""
    least, likely = _bounds(similarity)
    first, stars, deep, left = None, [], [], None
    frontier = _branch(classes.select("id", "sketch"), similarity, trees)
    for level in range(1, depth + 1):
        frontier = scratch.cut(frontier.distinct())
        # a node's center is its least id by exclusive or with a number of the level: another center on every level
        salt = F.lit(int(_numbers(level, 11)[-1]) >> 1)
        sizes = scratch.cut(frontier.groupBy("path").agg(F.count("*").alias("n"), F.min(F.col("id").bitwiseXOR(salt)).alias("center")).filter("n > 1"))
        large = sizes.filter(F.col("n") > leaf)
        some = large.limit(1).count() > 0
        in_leaf = frontier.join(sizes.filter(F.col("n") <= leaf), "path").withColumn("block", F.lit(0)).select("path", "block", "id", "n")
        if level == 1:
            first = scratch.cut(in_leaf)
        else:
            deep.append(scratch.cut(in_leaf.drop("n")))
        if not some:
            break
        members = scratch.cut(frontier.join(large, "path").select("path", "center", "id", "n"))
        # one star link of a document on a level is enough: the others would mostly join it to the same group
        star = members.groupBy("id").agg(F.min("center").alias("center")).select(F.col("center").bitwiseXOR(salt).alias("center"), "id")
        stars.append(star.filter("id <> center").select(F.least("center", "id").alias("a"), F.greatest("center", "id").alias("b")))
        if level == depth:
            left = members.select("path", "id")
            # two independent divisions into blocks, besides the star links
            number = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.ceil(F.col("n") / (leaf / 2))).cast("int") * 2 + k
            deep.append(members.select("path", F.explode(F.array(number(0), number(1))).alias("block"), "id"))
        else:
            frontier = _branch(members.select("path", "id").join(classes.select("id", "sketch"), "id"), similarity)
    out = scratch.cut(_compare(_leaves(first.withColumn("group", F.col("id")), classes), least, likely))
    if stars:
        out = out.unionByName(_agreeing(_union(stars).distinct(), classes, least))
    return out.groupBy("a", "b").agg(F.max("agree").alias("agree")), first.filter("n > 2").drop("n"), _union(deep) if deep else None, left


def _near(own: list[np.ndarray], percent: int) -> np.ndarray:
    """Whether 100 * intersection >= percent * union, by pair of shingle sets."""
    sizes = np.array([len(x) for x in own])
    values, places = np.unique(np.concatenate(own), return_inverse=True)
    counts = np.bincount(places, minlength=len(values))
    shared = counts[places] > 1
    # columns of the shingles that more than one member has
    column, row = (np.cumsum(counts > 1) - 1)[places[shared]], np.repeat(np.arange(len(own)), sizes)[shared]
    common = np.zeros((len(own), len(own)), np.int64)
    for at in range(0, int((counts > 1).sum()), COLUMNS):
        inside = (column >= at) & (column < at + COLUMNS)
        table = np.zeros((len(own), COLUMNS if column.max() >= at + COLUMNS else int(column.max()) + 1 - at), np.float32)
        table[row[inside], column[inside] - at] = 1
        common += np.rint(table @ table.T).astype(np.int64)
    return 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)


def _deep_links(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) within the leaves below large nodes, where near pairs are too many to give out for confirmation:
    each leaf compares its members' full sets, and links that join two of its groups come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, ["path", "block"]):
            left, right, ids = [], [], batch.column("id").to_numpy()
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                near = _near(_numbers_of(batch.column("shingles").slice(start, end - start)), percent)
                joined = np.arange(end - start)
                for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
                    if joined[i] != joined[j]:
                        joined[joined == joined[j]] = joined[i]
                        left.append(ids[start + i])
                        right.append(ids[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    members = rows.join(sets, "id").select("path", "block", "id", "shingles")
    return _together(members, "path", "block").mapInArrow(run, "u bigint, v bigint").distinct()


def _cross_links(rows: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between different groups in nodes (path, id) of any size: all such pairs of a node are compared on
    full sets, block against block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in whole_groups(batches, ["node", "low", "high"]):
            left, right, ids = [], [], batch.column("id").to_numpy()
            every, owner = batch.column("group").to_numpy(), batch.column("own").to_numpy()
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                group, own = every[start:end], owner[start:end]
                # the largest group's block is dealt to this pair of blocks only for the others' sake, and so may be alone
                wanted = np.triu(group[:, None] != group[None, :], 1)
                if own.min() < own.max():
                    wanted &= own[:, None] != own[None, :]
                if not wanted.any():
                    continue
                near = _near(_numbers_of(batch.column("shingles").slice(start, end - start)), percent) & wanted
                joined = {g: g for g in group.tolist()}
                for i, j in zip(*np.nonzero(near), strict=True):
                    x, y = joined[int(group[i])], joined[int(group[j])]
                    if x != y:
                        joined = {g: x if to == y else to for g, to in joined.items()}
                        left.append(ids[start + i])
                        right.append(ids[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["u", "v"])

    named = rows.join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id", "left").join(sets.select("id", (F.octet_length("shingles") / 8).alias("size")), "id")
    named = named.select(F.col("path").alias("node"), "id", F.coalesce("group", "id").alias("group"), "size")
    dealt = cross_blocks(named, CROSS, CROSS_SHINGLES).join(sets, "id").select("node", "low", "high", "own", "id", "group", "shingles")
    return _together(dealt, "node", "low", "high").mapInArrow(run, "u bigint, v bigint").distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def _still_apart(leaf_rows: DataFrame, groups: DataFrame, classes: DataFrame, done: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of leaf nodes whose documents confirmed links have not joined, though likely ones hid them."""
    named = leaf_rows.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("path", "block", "id", F.coalesce("component", "id").alias("group"))
    mixed = named.groupBy("path", "block").agg(F.min("group").alias("low"), F.max("group").alias("high")).filter("low < high").select("path", "block")
    pairs = _compare(_leaves(named.join(mixed, ["path", "block"]), classes), *_bounds(similarity), hidden=True).select("a", "b").distinct()
    return pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), words)], pa.binary())], ["id", "shingles"])

    # ids of 8 bytes: broadcast below a checked number of them, so that the texts needn't be shuffled
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    wanted = docs.select(F.col("doc_id").alias("id"), "text").join(ids, "id", "left_semi")
    return wanted.mapInArrow(run, "id bigint, shingles binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v): pairs with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(_numbers_of(batch.column("x")), _numbers_of(batch.column("y")), strict=True):
                both = np.sort(np.concatenate([a, b]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["u", "v"])

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """By document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "minhash")
    signed = scratch.cut(signatures(docs, words))
    classes = scratch.cut(signed.filter(F.col("digest").isNotNull() & F.col("doc_id").isNotNull()).groupBy("digest", "sketch").agg(F.min("doc_id").alias("id")))
    pairs, leaf_rows, deep, left = candidates(classes, scratch, percent / 100)
    pairs = scratch.cut(pairs)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    ids = scratch.cut((ids if deep is None else ids.unionByName(deep.select("id"))).distinct())
    sets = scratch.cut(_full_sets(docs, ids, words), "none")
    # the best pair of each document first; then those that still join two groups; then those that likely pairs hid
    best = pairs.groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("minus"))).alias("m")).select((-F.col("m.minus")).alias("a"), "b")
    links = _confirm(best, sets, percent)
    links = scratch.cut(links if deep is None else links.unionByName(_deep_links(deep, sets, percent)))
    groups = scratch.cut(components(links, scratch))
    of = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias(f"{side}_group"))
    open_pairs = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter(F.coalesce("a_group", "a") != F.coalesce("b_group", "b")).select("a", "b")
    # later rounds start from the stars of the groups, not from all links
    stars = lambda found: found.select(F.col("node").alias("u"), F.col("component").alias("v"))
    groups = scratch.cut(components(stars(groups).unionByName(_confirm(open_pairs, sets, percent)), scratch))
    hidden = scratch.cut(_still_apart(leaf_rows, groups, classes, pairs, percent / 100))
    if hidden.limit(1).count():
        groups = scratch.cut(components(stars(groups).unionByName(_confirm(hidden, sets, percent)), scratch))
    if left is not None:
        crossing = scratch.cut(_cross_links(left, groups, sets, percent))
        if crossing.limit(1).count():
            groups = components(stars(groups).unionByName(crossing), scratch)
    classed = signed.select("doc_id", "n_shingles", "digest").join(classes.select("digest", "id"), "digest", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return classed.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
