"""Near-duplicate embeddings by collision counting over sorted one-dimensional projections.

Equal vectors become one class with a weight. Classes are cut into slabs of a first projection's order; two slabs meet
only if they lie within its window, and a pair of slabs is one cell of work. In a cell every projection of the one side
is sorted, and the query-centred window of each vector of the other side is a range of that order, found by binary
search. A pair collides where its rank lies in the window (ranks are kept as 256 equal steps of the order and windows
end on whole steps, so rounding loses no collision). Pairs whose count over the first half of the projections reaches
its calibrated least are counted over the rest, and only those that reach the least of all projections are verified, by
cosine in double precision. No other pair's cosine is computed.

Calibration: two unit vectors at the threshold are d apart, so a projection's difference is normal with deviation d at
most; the window is one d, a collision has probability 0.683, and each least count is the one that a pair at the
threshold misses with probability under ``MISS``. Counts of links are sums over cells, so no pair is stored; a cell
gives at most a row for each of its vectors.

Work: at cosine 0.9 in 64 dimensions a random pair collides with probability 0.25 in a window where a pair at the
threshold does with 0.68, so every projection's windows hold a fixed share of all vectors and the counting grows with
the square of their number. Of random pairs 9 % reach the first count and some 1e-4 are verified.

Rows: vectors that are null, of no length or all zeros, or hold null or non-finite components link with nothing, as do
vectors of different lengths with each other and rows of a null vec_id (component null, kept true). Repeated rows count
as vectors of their own; kept is then true for each row whose vec_id is the component's. An empty table gives an empty
one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from millrace.llm.common import Scratch, ship, whole_groups
from millrace.llm.graph import components

#: Projections, half of them counted for all pairs; vectors of a slab; probability that a count misses a pair at the threshold.
PROJECTIONS, BLOCK, MISS = 64, 8192, 5e-5
#: Pairs that are counted further or verified at once; queries that are counted at once.
PAIRS, QUERIES = 1 << 14, 64


def least_count(m: int, p: float, miss: float) -> int:
    """The largest count that Binomial(m, p) misses with at most probability ``miss``."""
    total = 0.0
    for k in range(m + 1):
        total += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if total > miss:
            return k
    return m


def directions(dimension: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, m)).astype(np.float32)


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide = wide / np.abs(wide).max(axis=1, keepdims=True)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _packed(vectors: DataFrame, kind: str) -> DataFrame:
    """vec_id and the vector's numbers as bytes of numpy type ``kind``, null where it links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1):
                values = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and not v.values.null_count else np.empty(0)
                good = len(values) and np.isfinite(values).all() and values.any()
                out.append((values + np.zeros(1, kind)).tobytes() if good else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "raw"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, raw binary")


def _first_projection(classes: DataFrame, kind: str) -> DataFrame:
    """The classes with their dimension and their place in the first projection's order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw, kind) for raw in batch.column("raw").to_pylist()]
            at = [float(unit(v[None])[0] @ directions(len(v))[:, 0]) for v in own]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(v) for v in own], pa.int64()), pa.array(at, pa.float64())], ["id", "weight", "raw", "dimension", "at"])

    return classes.select("id", "weight", "raw").mapInArrow(run, "id bigint, weight bigint, raw binary, dimension bigint, at double")


def _dealt(placed: DataFrame, bounds: list[float], counts: dict[int, int], block: int, window: float) -> DataFrame:
    """Rows (dimension, low, high, own, id, weight, raw): each class in every cell (low, high) of its own block of a slab.

    Slab k lies between bounds k - 1 and k; one with more than ``block`` classes (of one direction, say) has several
    blocks, dealt by a hash. Blocks meet if their slabs are at most ``window`` apart.
    """
    slabs = len(bounds) + 1
    many = np.array([-(-counts.get(k, 1) // block) for k in range(slabs)])
    base = np.r_[0, np.cumsum(many)]
    low, high = np.r_[-np.inf, bounds], np.r_[bounds, np.inf]
    # the slabs whose blocks a slab's blocks meet are a range
    first = [int(np.searchsorted(high, low[k] - window)) for k in range(slabs)]
    last = [int(np.searchsorted(low, high[k] + window, "right")) for k in range(slabs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slab = np.searchsorted(bounds, batch.column("at").to_numpy(), "right")
            own = base[slab] + batch.column("deal").to_numpy() % many[slab]
            for k in np.unique(slab):
                rows = np.flatnonzero(slab == k)
                for other in range(base[first[k]], base[last[k]]):
                    part = batch.take(pa.array(rows))
                    columns = [np.minimum(own[rows], other), np.maximum(own[rows], other), own[rows]]
                    yield pa.RecordBatch.from_arrays([part.column("dimension"), *(pa.array(c) for c in columns), part.column("id"), part.column("weight"), part.column("raw")], ["dimension", "low", "high", "own", "id", "weight", "raw"])

    return placed.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(1 << 30))).mapInArrow(run, "dimension bigint, low bigint, high bigint, own bigint, id bigint, weight bigint, raw binary")


def _slab_counts(placed: DataFrame, bounds: list[float]) -> dict[int, int]:
    """Classes by slab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slab, n = np.unique(np.searchsorted(bounds, batch.column("at").to_numpy(), "right"), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slab, pa.int64()), pa.array(n, pa.int64())], ["slab", "n"])

    return {r.slab: r.n for r in placed.select("at").mapInArrow(run, "slab bigint, n bigint").groupBy("slab").agg(F.sum("n").alias("n")).collect()}


class Windows:
    """Sorted projections of the vectors y and the windows of the vectors x in their orders, in steps of a 256th."""

    def __init__(self, x: np.ndarray, y: np.ndarray, cosine: float) -> None:
        way, gap = directions(x.shape[1]), math.sqrt(2 - 2 * cosine) + 1e-5
        queries, values = x.astype(np.float32) @ way, y.astype(np.float32) @ way
        step = lambda rank: (rank * 256 // len(y)).astype(np.uint8)
        self.rank, self.start, self.span = (np.empty((PROJECTIONS, n), np.uint8) for n in (len(y), len(x), len(x)))
        for p in range(PROJECTIONS):
            order = np.argsort(values[:, p])
            ordered = values[order, p]
            self.rank[p, order] = step(np.arange(len(y)))
            start, stop = np.searchsorted(ordered, queries[:, p] - gap), np.searchsorted(ordered, queries[:, p] + gap, "right")
            self.start[p] = step(np.minimum(start, len(y) - 1))
            self.span[p] = step(np.maximum(stop - 1, np.minimum(start, len(y) - 1))) - self.start[p]

    def pairs(self, queries: slice) -> tuple[np.ndarray, np.ndarray]:
        """(query, row of y) of the pairs that reach the calibrated counts."""
        half, chance = PROJECTIONS // 2, math.erf(1 / math.sqrt(2))
        count = np.zeros((queries.stop - queries.start, self.rank.shape[1]), np.uint8)
        for p in range(half):
            count += (self.rank[p][None, :] - self.start[p, queries, None]) <= self.span[p, queries, None]
        i, j = np.nonzero(count >= least_count(half, chance, MISS))
        count, need, keep = count[i, j].astype(np.int64), least_count(PROJECTIONS, chance, MISS), []
        i += queries.start
        rank, start, span = (np.ascontiguousarray(v[half:].T) for v in (self.rank, self.start[:, queries], self.span[:, queries]))
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS] - queries.start, j[at : at + PAIRS]
            keep.append(at + np.flatnonzero(count[at : at + PAIRS] + ((rank[b] - start[a]) <= span[a]).sum(axis=1) >= need))
        keep = np.concatenate(keep) if keep else np.empty(0, np.int64)
        return i[keep], j[keep]


def block_links(x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of x (unit vectors) the rows of y that it links with, found by collision counts, then verified."""
    windows = Windows(x, y, cosine)
    for start in range(0, len(x), QUERIES):
        i, j = windows.pairs(slice(start, min(start + QUERIES, len(x))))
        met = np.zeros(len(i), bool)
        for at in range(0, len(i), PAIRS):
            some = slice(at, at + PAIRS)
            met[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]]) >= cosine
        met &= (i != j) | (not same)
        i, j = i[met], j[met]
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
        for at, found in zip(i[cuts].tolist(), np.split(j, cuts[1:]), strict=False):
            yield at, found


def _linked(cells: DataFrame, cosine: float, kind: str) -> DataFrame:
    """From cells, row by row: (id, other, n): sums of linked weights by vector (other null) and the vectors' groups
    within the cell (n null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, bounds in whole_groups(batches, ["dimension", "low", "high"]):
            for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                cell = rows.slice(begin, end - begin)
                every, weight, own = (cell.column(c).to_numpy() for c in ("id", "weight", "own"))
                vectors = unit(np.stack([np.frombuffer(v.as_buffer(), kind) for v in cell.column("raw")]))
                same = cell.column("low")[0] == cell.column("high")[0]
                one = own == own[0]
                if not same and one.all():
                    continue
                left, right = (np.arange(len(own)),) * 2 if same else (np.flatnonzero(one), np.flatnonzero(~one))
                n, order = np.zeros(len(every), np.int64), np.argsort(every, kind="stable")
                group = np.empty(len(every), np.int64)
                group[order] = np.arange(len(every))
                for i, found in block_links(vectors[left], vectors[right], cosine, same):
                    i, found = left[i], right[found]
                    n[i] += weight[found].sum()
                    if not same:
                        n[found] += weight[i]
                    if (group[found] != group[i]).any():
                        roots = np.unique(np.r_[group[i], group[found]])
                        group[np.isin(group, roots)] = roots[0]
                has = np.flatnonzero(n)
                nothing = pa.nulls(len(has), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(every[has]), nothing, pa.array(n[has])], ["id", "other", "n"])
                yield pa.RecordBatch.from_arrays([pa.array(every[has]), pa.array(every[order[group[has]]]), nothing], ["id", "other", "n"])

    return cells.mapInArrow(run, "id bigint, other bigint, n bigint")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, block: int = BLOCK) -> DataFrame:
    """By vector: vec_id, n_links (others with at least that cosine), component_id (smallest reachable), kept."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "vectors")
    # single precision as it is: unit vectors and cosines are in double precision all the same
    kind = "<f4" if vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull) else "<f8"
    packed = scratch.cut(_packed(vectors, kind))
    classes = scratch.cut(packed.filter("raw IS NOT NULL AND vec_id IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight")))
    placed = scratch.cut(_first_projection(classes, kind), "none")
    # as many slabs as keep a block's size, and enough for their pairs to reach all cores
    slabs = max(-(-placed.count() // block), math.isqrt(4 * spark.sparkContext.defaultParallelism))
    bounds = sorted(set(placed.approxQuantile("at", [k / slabs for k in range(1, slabs)], 0.1 / slabs)))
    counts = _slab_counts(placed, bounds)
    # the first projection's window holds a pair at the threshold but for MISS
    cells = _dealt(placed, bounds, counts, block, math.sqrt(2 - 2 * cosine) * 4.1)
    keys = ["dimension", "low", "high"]
    found = scratch.cut(_linked(cells.repartition(*keys).sortWithinPartitions(*keys, "id"), cosine, kind))
    links = found.filter("n IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n"))
    groups = components(found.filter("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")), scratch)
    own = classes.join(links, "id", "left").join(groups.withColumnRenamed("node", "id"), "id", "left")
    own = own.select("raw", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    met = packed.join(own, "raw", "left")
    counted = F.col("vec_id").isNotNull()
    component = F.when(counted, F.coalesce("component", "vec_id"))
    return met.select("vec_id", F.when(counted, F.coalesce("n", F.lit(0))).otherwise(F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
