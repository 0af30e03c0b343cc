"""Connected components of an edge table by contraction in blocks and alternating large-star and small-star rounds.

Links are contracted in blocks of at most about ``EDGES``, a task each, to a star per component of the block. One block
is the whole result; of several, the stars go through a large-star and small-star round and are contracted again.
Every such round is two aggregations and two equi-joins, so the graph stays distributed: neither
edges nor labels are gathered on the driver, and no node's neighbour list is built. The links of a node
with a large share of all links, such as the least one of a large component, are not dealt by that node: its
least neighbour is broadcast instead (``attach``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, cut


#: Links that one task contracts.
EDGES = 1 << 20


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links (a, b) of a block to (a, b) with b the least node of a's component in the block, for each node a."""
    parts = [b[["a", "b"]].to_numpy(np.int64) for b in batches if len(b)]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts), return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):  # the ends' roots as well, so that whole components move
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    yield pd.DataFrame({"a": nodes, "b": nodes[root]})


def _both(e: DataFrame) -> DataFrame:
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _print(e: DataFrame) -> tuple:
    """What tells one edge set from another: count and order-free sums; last, the most links of a node."""
    nodes = _both(e).groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b", "a")).alias("h"))
    h = F.xxhash64("a", "n", "h")
    return tuple(nodes.agg(F.sum("n"), F.bit_xor(h), F.sum(F.shiftright(h, 20)), F.max("n")).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` (a, b): undirected links. Returns (node, component), component the least node reachable.

    Self-links and links with a null end are ignored; nodes without links are not returned.
    The result has one row per linked node. Raises if ``max_rounds`` do not suffice.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = cut(e)
    before = None
    for _ in range(max_rounds):
        n = e.count()
        stars = e.coalesce(max(1, -(-n // EDGES))).mapInPandas(_contract, "a long, b long")
        if n <= EDGES:
            return cut(stars).select(F.col("a").alias("node"), F.col("b").alias("component"))
        e = cut(stars.where("a <> b").distinct())
        before = before or _print(e)
        both, uneven = _both(e), before[3] > max(256, before[0] // 1000)
        join = (lambda rows, values: attach(rows, ["a"], values, before[0] // 2)) if uneven else (lambda rows, values: rows.join(values, "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = join(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b")  # repeats do no harm; the round's end removes them
        first = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        hooks = join(large, first).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        e = cut(hooks.unionByName(first.select("a", F.col("m").alias("b"))).distinct())
        after = _print(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component"))
    ).distinct()
