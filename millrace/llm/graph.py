"""Connected components of a link table by alternating large-star and small-star rounds (distributed union-find)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

MOST_ROUNDS = 60
#: Links up to which a round's least neighbours (at most two rows a link, 16 bytes each) are broadcast.
BROADCAST_LINKS = 500_000
#: Links up to which the driver joins them itself (16 bytes each): rounds of shuffles cost more than all else there.
DRIVER_LINKS = 500_000


def least_reachable(count: int, u: np.ndarray, v: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest reachable of the nodes 0 to ``count`` - 1 by node, over the links (u, v) and those behind ``root``."""
    root = np.arange(count) if root is None else root.copy()
    while len(u):
        a, b = root[u], root[v]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return root


def columns_of(frame: DataFrame) -> list[np.ndarray]:
    """The columns of a frame of few rows, numbers without nulls, on the driver."""
    return [c.to_numpy() for c in frame.toArrow().columns]


def frame_of(like: DataFrame, **columns: np.ndarray) -> DataFrame:
    """A frame of 64-bit numbers, in the session of another."""
    made = pa.table({k: pa.array(x, pa.int64()) for k, x in columns.items()})
    return like.sparkSession.createDataFrame(made, ", ".join(f"{k} bigint" for k in columns))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v), component being the smallest node reachable.

    A round hangs each node's larger neighbours on its least neighbour (large star), then its smaller ones (small star).
    Edges shrink to stars around the least nodes in a logarithmic number of rounds; each round is written to the shared
    folder, so lineage stays short. Only two numbers a round reach the driver. Self-links and nulls are ignored. Links of at
    most a checked number are joined on the driver instead, with the same result.

    A star's centre is one key for all its links. Below a checked number of links the least neighbours are broadcast, so
    no key gathers anywhere; beyond it they are written first, so that both sides of the join are plain shuffles and
    adaptive execution can split the centre's side.
    """
    u, v = F.col("u"), F.col("v")
    now = scratch.cut(edges.filter(u != v).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if now.count() <= DRIVER_LINKS:
        high, low = columns_of(now)
        nodes, at = np.unique(np.r_[high, low], return_inverse=True)
        return frame_of(now, node=nodes, component=nodes[least_reachable(len(nodes), *np.split(at, 2))])
    print_now, old = _fingerprint(now), None
    for _ in range(MOST_ROUNDS):
        if print_now == old:
            break
        small, used = print_now[0] <= BROADCAST_LINKS, []

        def beside(least: DataFrame, small: bool = small, used: list = used) -> DataFrame:
            if small:
                return F.broadcast(least)
            used.append(scratch.cut(least))
            return used[-1]

        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = beside(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = scratch.cut(both.filter(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct())
        least = beside(large.groupBy("u").agg(F.min("v").alias("m")))
        hung = large.join(least, "u").select(F.explode(F.array(F.struct(u.alias("u"), F.col("m").alias("v")), F.struct(v.alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter(u != v).distinct()
        made = scratch.cut(hung)
        scratch.drop(now, large, *used)
        now, old, print_now = made, print_now, _fingerprint(made)
    else:
        raise RuntimeError("components did not settle")
    return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())


def cross_blocks(members: DataFrame, block: int, block_size: int, *more: str) -> DataFrame:
    """Deal the members (node, id, group, size) of nodes with several groups to pairs of blocks of about ``block`` members
    and at most about ``block_size`` in size: (node, low, high, own, id, group) and the columns named besides. Two members of different groups of a node
    meet in exactly one (low, high), one of them with own = low and the other with own = high (or both in low = high).
    The largest group's blocks only meet those of the other groups."""
    sizes = members.groupBy("node", "group").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    nodes = sizes.groupBy("node").agg(F.max(F.struct("n", "group", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size")).filter(F.col("main.n") < F.col("n"))
    blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / block_size)).cast("int")
    nodes = nodes.select("node", F.col("main.group").alias("main"), blocks(F.col("main.n"), F.col("main.size")).alias("of_main"), blocks(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("of_rest"))
    in_main, number = F.col("group") == F.col("main"), F.xxhash64("id", F.lit(5))
    own = F.when(in_main, F.col("of_rest") + F.pmod(number, F.col("of_main"))).otherwise(F.pmod(number, F.col("of_rest"))).cast("int")
    last = F.when(in_main, F.col("of_rest")).otherwise(F.col("of_rest") + F.col("of_main")) - 1
    dealt = members.join(nodes, "node").select("node", "id", "group", *more, own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return dealt.select("node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "id", "group", *more)


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
