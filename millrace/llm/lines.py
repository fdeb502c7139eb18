"""Fuzzy line deduplication by MinHash, in DataFrame operations only.

A line is compared in lower case without surrounding blanks, as its set of ten-character shingles; a shorter line is one
shingle. Equal lines (equal 128-bit fingerprints) are one class.

1. One scan explodes shingle positions and keeps, by fingerprint, the least value of nine hashes (aggregated before the
   shuffle, so copies of a line cost one row). The nine minima are the points of the affine plane of order three, and its
   twelve lines of three points are the bands: any five equal minima hold a whole band.
2. Classes with an equal band are in one bucket. A bucket of two is a pair; in a larger one each class is paired with two
   centers: the class that the most others meet, likely the middle of a family, and the shortest one, which holds the least
   beside a passage that all share. A class has a sketch, in which each shingle of its set turns one of 1,024 bits over.
   Pairs whose sketches differ in more bits than near sets' can are ruled out, without loss; the others are compared
   exactly, on full shingle sets, and links go through union-find.
3. In buckets whose classes are still in more than one group, classes of different groups meet: those of a large bucket in
   random small sets first, then all, block against block, each pair in the first bucket that it shares. Of the pairs that
   sketches leave, each group's closest is compared first, and one whose groups are joined by then is not compared; all
   others are, exactly. So all that share a bucket are compared, ruled out without loss or joined.
4. The first line of each component, by doc_id and line number, stays.

Recall: a pair of similarity 0.8 shares a bucket with probability 0.990, one of 0.9 with 0.9996. Buckets are never held
in one task; a block has at most ``BLOCK`` lines or ``BLOCK_CHARS`` characters, or one longer line. Work in a family of
lines that are alike below the threshold grows with the square of its number of groups.

Rows: null and empty texts have no lines. Lines of a null doc_id come after all others. Rows of equal doc_id (nulls too)
and text count as one; rows of equal doc_id and different texts are told apart by their texts' hashes. Ties go to the
smaller hash. A line needs memory of some 30 bytes a character where it is compared. An empty table gives an empty one;
other columns are not read by ``line_groups`` and pass through ``dedup_lines``, whatever their names.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch
from millrace.llm import graph
from millrace.llm.graph import columns_of, components, cross_blocks, frame_of, least_reachable

SHINGLE, MIN_CHARS = 10, 20
#: The lines of the affine plane of order three: minima of each band.
BANDS = ((0, 1, 2), (3, 4, 5), (6, 7, 8), (0, 3, 6), (1, 4, 7), (2, 5, 8), (0, 4, 8), (1, 5, 6), (2, 3, 7), (0, 5, 7), (1, 3, 8), (2, 4, 6))
#: Shingle positions that one exploded row covers.
UNROLL = 16
#: Most rows of at most some 60 bytes (fingerprints, ids, places) that are broadcast.
BROADCAST_KEYS = 500_000
#: Lines of a bucket, and their bytes in UTF-16, that are compared at once with as many others.
BLOCK, BLOCK_BYTES = 512, 1 << 19
#: Rounds in which pairs of a bucket are compared, the last one on all that are left.
ROUNDS = 3
#: Members of a large bucket that meet in one small set before all meet.
FEW = 8
#: 64-bit words of a line's sketch, a power of two, and shingles that one row adds to it.
WORDS, ADDED = 16, 8

_BITS = 1 << 30  # of a text's hash, to tell apart rows of one doc_id
_LAST = Decimal(1 << 63)  # in place of a null doc_id


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, line_no, the line as compared, its fingerprint k1 and k2, and the text's own, t1 and t2."""
    # hashed before the lines are made, else a text is hashed again for each of its lines
    hashed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.split("text", "\n").alias("parts"))
    texts = hashed.select("doc_id", "t1", "t2", F.posexplode("parts").alias("line_no", "line"))
    # a generator's output, else the optimizer copies the expression into the filter and each line is lowered twice
    every = texts.select("doc_id", "t1", "t2", "line_no", F.explode(F.array(F.lower(F.trim("line")))).alias("norm"))
    # a character has one to four bytes: only short lines' characters are counted
    least = max(min_chars, 1)
    every = every.filter(f"octet_length(norm) >= {least}" + f" AND (octet_length(norm) >= {4 * least} OR length(norm) >= {least})" * (least > 1))
    return every.withColumns({"k1": F.xxhash64("norm"), "k2": F.xxhash64(F.lit(1), "norm")})


def _small(frame: DataFrame) -> DataFrame:
    """To be broadcast below a checked number of rows."""
    return F.broadcast(frame) if frame.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else frame


def _classes(lines: DataFrame, shingle: int) -> DataFrame:
    """id, k1, k2, n (lines), size (in bytes) and keys (of the bands) of the different lines. Hash j's order is by exclusive or with a fixed number."""
    width = 2 * shingle  # bytes; UTF-16 gives constant-time substrings
    minima = 1 + max(p for band in BANDS for p in band)
    salts = [(0x9E3779B1 * (j + 1) & 0xFFFFFFFF) - (1 << 31) for j in range(minima)]
    coded = lines.select("k1", "k2", F.encode("norm", "UTF-16BE").alias("b"))
    at = coded.select("k1", "k2", "b", F.explode(F.expr(f"sequence(1, greatest(octet_length(b) - {width - 1}, 1), {2 * UNROLL})")).alias("i"))
    hashed = at.select("k1", "k2", "b", "i", F.expr(f"hash(substring(b, i, {width}))").alias("h0"))
    more = [F.expr(f"if(i + {2 * j} <= octet_length(b) - {width - 1}, hash(substring(b, i + {2 * j}, {width})), h0)").alias(f"h{j}") for j in range(1, UNROLL)]
    hashed = hashed.select("k1", "k2", F.expr("if(i = 1, 1L, 0L)").alias("one"), F.octet_length("b").alias("size"), "h0", *more)
    least = [F.min(F.least(*[F.col(f"h{j}").bitwiseXOR(F.lit(s)) for j in range(UNROLL)])).alias(f"m{n}") for n, s in enumerate(salts)]
    signed = hashed.groupBy("k1", "k2").agg(F.sum("one").alias("n"), F.max("size").alias("size"), *least)
    keys = [F.xxhash64(F.lit(j), *[F.col(f"m{p}") for p in band]) for j, band in enumerate(BANDS)]
    return signed.select(F.monotonically_increasing_id().alias("id"), "k1", "k2", "n", "size", F.array(*keys).alias("keys"))


def _members(classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs (u < v): buckets of two, and each member of a larger bucket with its centers, the class that the most others meet
    and the shortest one, which has the least beside a passage that all share; members (node, id, size, earlier) of larger
    buckets, with the keys of the bands before."""
    banded = classes.select("id", F.explode("keys").alias("node"))
    buckets = scratch.cut(banded.groupBy("node").agg(F.min("id").alias("u"), F.max("id").alias("v"), F.count("*").alias("n")).filter("n > 1"))
    crowded = _small(buckets.filter("n > 2").select("node", "n"))
    placed = classes.select("id", "size", "keys", F.posexplode("keys").alias("at", "node")).join(crowded, "node")
    members = scratch.cut(placed.select("node", "id", "size", "n", F.slice("keys", F.lit(1), F.col("at")).alias("earlier")))
    met = members.groupBy("id").agg(F.sum("n").alias("met"))
    ranked = members.select("node", "id", "size").join(met, "id").groupBy("node")
    centers = scratch.cut(ranked.agg(F.max(F.struct("met", "id")).alias("m"), F.min(F.struct("size", "id")).alias("s")).select("node", F.array_distinct(F.array("m.id", "s.id")).alias("centers")))
    stars = members.select("node", "id").join(_small(centers), "node").select("id", F.explode("centers").alias("center")).filter("id <> center")
    stars = stars.select(F.least("id", "center").alias("u"), F.greatest("id", "center").alias("v"))
    return scratch.cut(buckets.filter("n = 2").select("u", "v").unionByName(stars).distinct()), members.select("node", "id", "size", "earlier")


def _place() -> Column:
    """Lines in order: by doc_id, a null one last, line number and, to tell apart rows of one doc_id, the text's hash."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(_LAST))
    rest = F.col("line_no").cast("bigint") * _BITS + F.pmod("t1", F.lit(_BITS))
    return (doc * F.lit(1 << 61).cast("decimal(19,0)") + rest.cast("decimal(19,0)")).cast("decimal(38,0)")


def _marked(lines: DataFrame, classes: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """All lines: doc_id, t1, t2, line_no, id of the classes that are wanted or have several lines, else null, and norm, the
    line where it is wanted. Written, so that no later step splits and hashes the texts again."""
    flagged = classes.select("id", "k1", "k2", "n").join(_small(scratch.cut(wanted)).withColumn("wanted", F.lit(True)), "id", "left").filter("n > 1 OR wanted")
    keys = _small(scratch.cut(flagged.select("id", "k1", "k2", F.coalesce("wanted", F.lit(False)).alias("wanted"))))
    met = lines.join(keys, ["k1", "k2"], "left")
    return scratch.cut(met.select("doc_id", "t1", "t2", "line_no", "id", F.when(F.col("wanted"), F.col("norm")).alias("norm")))


def _seen(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """id, norm (where it is wanted), first place and n (lines) of the classes that the lines are marked with."""
    met = marked.filter("id IS NOT NULL").select("id", _place().alias("place"), "norm")
    return scratch.cut(met.groupBy("id", "norm").agg(F.min("place").alias("place"), F.count("*").alias("n")))


def _grams(coded: str, shingle: int) -> str:
    """SQL of the set of shingles of a line in UTF-32, as 64-bit hashes. The line is a variable of the outer function: a column
    of bytes would be copied as a whole for each shingle."""
    hashes = f"transform(sequence(1, greatest(octet_length(b) - {4 * shingle - 1}, 1), 4), i -> xxhash64(substring(b, i, {4 * shingle})))"
    return f"array_distinct(element_at(transform(array({coded}), b -> {hashes}), 1))"


def _near(x: str, y: str, percent: int) -> str:
    """SQL of 100 * intersection >= percent * union, the sizes' ratio first."""
    sizes = f"100 * least(size({x}), size({y})) >= {percent} * greatest(size({x}), size({y}))"
    return f"{sizes} AND {100 + percent} * size(array_intersect({x}, {y})) >= {percent} * (size({x}) + size({y}))"


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """id and bits of the lines: n, the size of the set, and w0 ..., in which each shingle of the set turns one bit over."""
    sets = texts.select("id", F.expr(_grams("encode(norm, 'UTF-32')", shingle)).alias("g"))
    at = sets.select("id", "g", F.explode(F.expr(f"sequence(0, size(g) - 1, {ADDED})")).alias("i"))
    hashed = at.select("id", F.expr("if(i = 0, size(g), 0)").alias("n"), *[F.expr(f"get(g, i + {j})").alias(f"h{j}") for j in range(ADDED)])
    # beyond a set's end is no word's bit; without nulls the generated code is shorter
    parts = [F.expr(x) for j in range(ADDED) for x in (f"coalesce(shiftright(h{j}, 6) & {WORDS - 1}, -1L) AS p{j}", f"coalesce(shiftleft(1L, CAST(h{j} & 63 AS INT)), 0L) AS b{j}")]
    words = [F.expr("bit_xor(" + " ^ ".join(f"if(p{j} = {w}, b{j}, 0L)" for j in range(ADDED)) + f") AS w{w}") for w in range(WORDS)]
    made = hashed.select("id", "n", *parts).groupBy("id").agg(F.sum("n").alias("n"), *words)
    return made.select("id", F.struct("n", *[f"w{w}" for w in range(WORDS)]).alias("bits"))


def _differing(x: str, y: str) -> str:
    """SQL of the number of bits in which two sketches differ."""
    return " + ".join(f"bit_count({x}w{w} ^ {y}w{w})" for w in range(WORDS))


def _may_be_near(x: str, y: str, percent: int) -> str:
    """SQL that holds for all near pairs: of near sets at most (100 - percent) / (100 + percent) of the sizes' sum is in one
    set alone, and a bit in which their sketches differ takes one such shingle at least."""
    sizes = f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n)"
    return f"{sizes} AND {100 + percent} * ({_differing(x, y)}) <= {100 - percent} * ({x}n + {y}n)"


def _confirm(pairs: DataFrame, seen: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links among the pairs, on full shingle sets."""
    few = _small(pairs.select("u", "v"))
    side = lambda key, name: seen.select(F.col("id").alias(key), F.col("norm").alias(name))
    # where pairs are few, texts that they don't name are not shuffled
    other = side("v", "y").join(few.select("v").distinct() if few is not pairs else few, "v", "left_semi")
    met = side("u", "x").join(few, "u").join(other, "v")
    # the generator keeps the optimizer from copying an expression into each of its uses
    grams = [_grams(f"encode({name}, 'UTF-32')", shingle) + f" AS {name}" for name in ("x", "y")]
    sets = met.select("u", "v", F.explode(F.expr(f"array(struct({', '.join(grams)}))")).alias("s"))
    return sets.filter(_near("s.x", "s.y", percent)).select("u", "v")


def _likely(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs without those that their sketches rule out."""
    bits = lambda key, name: sketches.select(F.col("id").alias(key), F.col("bits").alias(name))
    return pairs.join(bits("u", "p"), "u").join(bits("v", "q"), "v").filter(_may_be_near("p.", "q.", percent)).select("u", "v")


def _grouped(members: DataFrame, groups: DataFrame) -> DataFrame:
    """The members with their groups; a class without links is its own."""
    named = members.join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id", "left")
    return named.select("node", "id", F.coalesce("group", "id").alias("group"), "size", "earlier")


def _apart(x: str, y: str) -> Column:
    """How far two sketches are apart, in proportion to the sets' sizes."""
    return F.expr(f"CAST(1000000L * ({_differing(x, y)}) / ({x}n + {y}n) AS INT)").alias("apart")


def _some_pairs(members: DataFrame, groups: DataFrame, sketches: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Of the pairs that _cross_pairs has those in random small sets of a large bucket's members: enough to join most of a
    family whose members are alike, so that fewer groups are left of which all pairs meet."""
    named = scratch.cut(_grouped(members, groups).drop("size", "earlier"))
    large = named.groupBy("node").agg(F.count("*").alias("n"), F.min("group").alias("g0"), F.max("group").alias("g1")).filter(f"n > {2 * FEW} AND g0 < g1")
    dealt = named.join(_small(scratch.cut(large.select("node", "n"))), "node")
    dealt = scratch.cut(dealt.select("node", F.pmod(F.xxhash64("node", "id"), F.ceil(F.col("n") / FEW)).alias("part"), "id", "group"))
    x = dealt.select("node", "part", F.col("id").alias("u"), F.col("group").alias("gu"))
    y = dealt.select("node", "part", F.col("id").alias("v"), F.col("group").alias("gv"))
    met = scratch.cut(x.join(y, ["node", "part"]).filter("u < v AND gu <> gv").select("u", "v", "gu", "gv").distinct())
    bits = lambda key, name: sketches.select(F.col("id").alias(key), F.col("bits").alias(name))
    near = met.join(bits("u", "p"), "u").join(bits("v", "q"), "v").filter(_may_be_near("p.", "q.", percent))
    return scratch.cut(near.select("u", "v", "gu", "gv", _apart("p.", "q.")))


def _cross_pairs(members: DataFrame, groups: DataFrame, sketches: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (u, v) of classes of different groups (gu, gv) that share a bucket and that their sketches don't rule out, each in
    the first bucket it shares, and how far the sketches are apart."""
    named = scratch.cut(_grouped(members, groups))
    # of buckets with the same members the one of the first band does
    print_of = [F.sum(F.xxhash64(F.lit(k), "id").cast("decimal(38,0)")).alias(f"s{k}") for k in range(2)]
    alike = named.groupBy("node").agg(F.min(F.size("earlier")).alias("at"), F.count("*").alias("n"), F.min("group").alias("g0"), F.max("group").alias("g1"), *print_of).filter("g0 < g1")
    alike = alike.groupBy("n", "s0", "s1").agg(F.min(F.struct("at", "node")).alias("one"))
    named = scratch.cut(named.join(_small(scratch.cut(alike.select(F.col("one.node").alias("node")))), "node", "left_semi"))
    marked = scratch.cut(cross_blocks(named, BLOCK, BLOCK_BYTES, "earlier").join(sketches, "id"))
    # plain columns: a pair reads them without making structs, and without nulls the generated code is shorter
    names, sketch = ["id", "group", "earlier", "n"], [f"w{w}" for w in range(WORDS)]
    plain = marked.select("node", "low", "high", "own", "earlier", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c.split(".")[-1]) for c in ("id", "group", "bits.n", *[f"bits.{w}" for w in sketch])])
    side = lambda own, tag: plain.filter(f"own = {own}").select("node", "low", "high", *[F.col(c).alias(f"{tag}_{c}") for c in names + sketch])
    x, y = side("low", "x").alias("a"), side("high", "y").alias("b")
    once = "x_group <> y_group AND (a.low < a.high OR x_id < y_id)"
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("node", "low", "high")]
    met = x.join(y, [*on, F.expr(f"{once} AND {_may_be_near('x_', 'y_', percent)} AND NOT arrays_overlap(x_earlier, y_earlier)")])
    return scratch.cut(met.select(F.col("x_id").alias("u"), F.col("y_id").alias("v"), F.col("x_group").alias("gu"), F.col("y_group").alias("gv"), _apart("x_", "y_")))


def _join_few(pairs: DataFrame, seen: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, component) of the groups that links among few pairs join. The driver picks the pairs of a round; they are
    compared on the executors."""
    u, v, gu, gv, apart = columns_of(pairs.select("u", "v", "gu", "gv", "apart"))
    names, at = np.unique(np.r_[gu, gv], return_inverse=True)
    ids, one = np.unique(np.r_[u, v], return_index=True)
    group_of = at[one]
    a, b = np.split(at, 2)
    root, left = np.arange(len(names)), np.flatnonzero(a != b)
    for rounds in range(1, ROUNDS + 1):
        if not len(left):
            break
        sides, pair = np.r_[root[a[left]], root[b[left]]], np.r_[left, left]
        order = np.lexsort((v[pair], u[pair], apart[pair], sides))
        first = np.unique(pair[order][np.r_[True, np.diff(sides[order]) != 0]])
        last = rounds == ROUNDS or 2 * len(first) >= len(left)
        now = left if last else first
        links = columns_of(_confirm(frame_of(pairs, u=u[now], v=v[now]), seen, shingle, percent))
        root = least_reachable(len(names), *(group_of[np.searchsorted(ids, x)] for x in links), root)
        if last:
            break
        left = np.setdiff1d(left, first)
        left = left[root[a[left]] != root[b[left]]]
    moved = np.bincount(root, minlength=len(names))[root] > 1
    return frame_of(pairs, node=names[moved], component=names[root[moved]])


def _join_groups(groups: DataFrame, pairs: DataFrame, seen: DataFrame, scratch: Scratch, shingle: int, percent: int) -> DataFrame:
    """(node, component) after the links among the pairs (u, v, gu, gv, apart) of classes of different groups. Each group's
    closest pair is compared first, round by round; a pair whose groups are joined by then needs no comparison, all others
    get it."""
    joined, rounds = None, 0
    while left := pairs.count():
        if left <= graph.DRIVER_LINKS and joined is None:
            joined = _join_few(pairs, seen, shingle, percent)
            break
        rounds += 1
        sides = pairs.select(F.explode(F.array("gu", "gv")).alias("g"), F.struct("apart", "u", "v").alias("pair"))
        first = scratch.cut(sides.groupBy("g").agg(F.min("pair").alias("pair")).select("pair.u", "pair.v").distinct())
        last = rounds == ROUNDS or 2 * first.count() >= left
        links = scratch.cut(_confirm(pairs if last else first, seen, shingle, percent))
        found = pairs.join(_small(links), ["u", "v"]).select(F.col("gu").alias("u"), F.col("gv").alias("v"))
        if joined is not None:
            found = found.unionByName(joined.select(F.col("node").alias("u"), F.col("component").alias("v")))
        joined = scratch.cut(components(found, scratch))
        if last:
            break
        names = _small(joined)
        now = pairs.join(_small(first), ["u", "v"], "left_anti")
        for g in ("gu", "gv"):
            now = now.join(names.select(F.col("node").alias(g), F.col("component").alias("c")), g, "left").withColumn(g, F.coalesce("c", g)).drop("c")
        pairs = scratch.cut(now.filter("gu <> gv"))
    if joined is None:
        return groups
    # joined is between groups: members of a joined one move, and classes without links before are new
    moved = groups.join(_small(joined.select(F.col("node").alias("component"), F.col("component").alias("c"))), "component", "left")
    new = joined.join(_small(groups.select("node")), "node", "left_anti")
    return scratch.cut(moved.select("node", F.coalesce("c", "component").alias("component")).unionByName(new.select("node", "component")))


def _placed(docs: DataFrame, shingle: int, percent: int, min_chars: int) -> DataFrame:
    """By line: doc_id, t1, t2, line_no, first_doc_id, first_line_no, group_lines and kept."""
    scratch = Scratch(docs.sparkSession, "lines")
    lines = _lines(docs, min_chars)
    classes = scratch.cut(_classes(lines, shingle))
    pairs, members = _members(classes, scratch)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    marked = _marked(lines, classes, wanted, scratch)
    seen = _seen(marked, scratch)
    sketches = scratch.cut(_sketches(seen.filter("norm IS NOT NULL"), shingle))
    links = scratch.cut(_confirm(scratch.cut(_likely(pairs, sketches, percent)), seen, shingle, percent))
    groups = scratch.cut(components(links, scratch))
    for pairs_of in (_some_pairs, _cross_pairs):
        groups = _join_groups(groups, pairs_of(members, groups, sketches, scratch, percent), seen, scratch, shingle, percent)
    named = seen.select("id", "place", "n").join(groups.select(F.col("node").alias("id"), "component"), "id", "left")
    named = scratch.cut(named.withColumn("component", F.coalesce("component", "id")))
    # written, so that both sides of the join are shuffles of their own and a hot group's side can be split
    whole = scratch.cut(named.groupBy("component").agg(F.min("place").alias("first"), F.sum("n").alias("group_lines")).filter("group_lines > 1"))
    base, low = F.lit(1 << 61).cast("decimal(19,0)"), F.col("low")
    doc = F.floor(F.col("first") / base).cast("decimal(19,0)")
    first = named.join(whole, "component").select("id", "group_lines", doc.alias("doc"), (F.col("first") - doc * base).cast("bigint").alias("low"))
    first = first.select("id", "group_lines", F.when(F.col("doc") != F.lit(_LAST), F.col("doc").cast("bigint")).alias("first_doc_id"), F.shiftright(low, 30).cast("int").alias("first_line_no"), F.pmod(low, F.lit(_BITS)).alias("tie"))
    # lines without a mark meet nothing; numbers below all ids deal them out where the join is a shuffle
    nothing = -1 - F.shiftrightunsigned(F.xxhash64("t1", "line_no"), 1)
    met = marked.drop("norm").withColumn("id", F.coalesce("id", nothing)).join(_small(scratch.cut(first)), "id", "left")
    alone = F.col("group_lines").isNull()
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no")) & (F.pmod("t1", F.lit(_BITS)) == F.col("tie"))
    return met.select(
        "doc_id",
        "t1",
        "t2",
        "line_no",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_doc_id")).alias("first_doc_id"),
        F.when(alone, F.col("line_no")).otherwise(F.col("first_line_no")).alias("first_line_no"),
        F.coalesce("group_lines", F.lit(1)).alias("group_lines"),
        (alone | kept).alias("kept"),
    )


def line_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, min_chars: int = MIN_CHARS) -> DataFrame:
    """By line of at least ``min_chars`` (1 for all that aren't blank): doc_id, line_no, the first line of its component
    (first_doc_id, first_line_no), the component's number of lines, and whether the line stays (kept)."""
    return _placed(docs, shingle, percent, min_chars).drop("t1", "t2")


def dedup_lines(docs: DataFrame, shingle: int = SHINGLE, percent: int = 80, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that repeat an earlier one; a document that loses its last text goes. Lines of
    fewer than ``min_chars`` characters stay: headings, brackets and the like repeat without being copies."""
    scratch = Scratch(docs.sparkSession, "lines")
    lost = _placed(docs, shingle, percent, min_chars).filter("NOT kept").groupBy("doc_id", "t1", "t2").agg(F.collect_set("line_no").alias("lost"))
    lost = scratch.cut(lost)
    numbers = lost.agg(F.coalesce(F.sum(F.size("lost") + 8), F.lit(0))).first()[0]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    lost = lost.withColumnRenamed("doc_id", "own_id")
    on = rows["doc_id"].eqNullSafe(lost["own_id"]) & (rows["t1"] == lost["t1"]) & (rows["t2"] == lost["t2"])
    # four bytes a line: broadcast below a checked number of them, so that the texts needn't be shuffled
    met = rows.join(F.broadcast(lost) if numbers <= 8 * BROADCAST_KEYS else lost, on, "left").select("row", "lost", F.split("row.text", "\n").alias("parts"))
    left = F.expr("array_join(transform(array_except(sequence(0, size(parts) - 1), lost), i -> parts[i]), '\n')")
    text = F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(left)
    out = met.select("row", F.explode(F.filter(F.array(text), lambda t: F.col("lost").isNull() | (F.trim(t) != ""))).alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
