"""Embedding near-duplicates with a random-projection tree forest.

Each tree splits recursively by random directions; vectors near a split go to both sides (spill). The upper
splits are fitted, at quantiles, on a bounded sample of ``SAMPLE`` vectors; below a fitted leaf the tree goes on
with directions drawn from the node's number and thresholds at the leaf's centre, as deep as the number of
rows asks for, so leaves keep their size however many rows there are and the broadcast forest keeps its own.
All rows are routed through all trees; vectors are compared within leaves in double precision.

Copies are one class from the start. A pair that meets in several leaves counts in the first one only, known from
the leaves that each row carries, so links are counted where they are found: a leaf returns one row per
vector (links, least vector of its local component), never pairs. A node whose vectors are so close together that a
split would send most of them both ways stays a leaf at any depth; it is compared in pairs of blocks by several tasks,
and nothing is capped. A task compares many small leaves in one call.

Defined results: a vector that is null, empty, all zero, or holds nulls or non-finite numbers, or whose label is
null, links with nothing and is its own component; vectors of different lengths do not link; repeated rows are
copies of each other; a null vec_id takes part but is never a component id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_block, maybe_broadcast, stage, table
from .components import connected_components

COSINE, TREES = 0.98, 6
SAMPLE, LEAF_SAMPLE = 20_000, 32
#: Rows a leaf should hold, and rows of a block of a leaf that holds more.
LEAF, BLOCK = 256, 1024
#: Spill: width of the overlap on either side of a split, in units of 1/sqrt(dimension); share of a node's sample that a split may send both ways.
MARGIN, SPILL = 0.08, 0.5
#: Vectors of a leaf whose distances from its centre have a root mean square below this would spill by more than ``SPILL`` in every split.
CROWDED = MARGIN / 0.6745  # the normal quantile of 0.75


@dataclass
class Tree:
    """Fitted splits: node i has direction[i], threshold[i] and two children (negative: leaf -1 - child)."""

    direction: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    centres: np.ndarray
    crowded: np.ndarray
    seed: int


def fit_tree(x: np.ndarray, seed: int, leaf: int = LEAF_SAMPLE) -> Tree:
    rng = np.random.default_rng([5, seed])
    dirs, cuts, kids, centres, crowded = [], [], [], [], []
    margin = MARGIN / math.sqrt(x.shape[1])

    def close(i: np.ndarray) -> int:
        centre = x[i].mean(axis=0) if len(i) else np.zeros(x.shape[1])
        centres.append(centre)
        crowded.append(len(i) > 1 and bool(np.sqrt(((x[i] - centre) ** 2).sum(axis=1).mean()) < CROWDED))
        return -len(centres)

    def grow(i: np.ndarray, depth: int) -> int:
        if len(i) <= leaf or depth >= 40:
            return close(i)
        u = rng.standard_normal(x.shape[1])
        u /= np.linalg.norm(u)
        p = x[i] @ u
        cut = float(np.quantile(p, rng.uniform(0.4, 0.6)))
        low = p < cut
        if not low.any() or low.all() or (np.abs(p - cut) < margin).mean() > SPILL:
            return close(i)
        at = len(dirs)
        dirs.append(u)
        cuts.append(cut)
        kids.append([0, 0])
        kids[at][0] = grow(i[low], depth + 1)
        kids[at][1] = grow(i[~low], depth + 1)
        return at

    grow(np.arange(len(x)), 0)
    d = x.shape[1]
    return Tree(np.array(dirs).reshape(-1, d), np.array(cuts), np.array(kids, np.int64).reshape(-1, 2), np.array(centres).reshape(-1, d), np.array(crowded, bool), seed)


def route(tree: Tree, x: np.ndarray, extra: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs: every row's leaves in the tree, more than one where it is near a split."""
    out_r, out_l = [], []
    todo = [(0 if len(tree.direction) else -1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node >= 0:
            p = x[rows] @ tree.direction[node] - tree.threshold[node]
            todo += [(int(tree.children[node, 0]), rows[p < margin]), (int(tree.children[node, 1]), rows[p >= -margin])]
            continue
        leaf = -1 - node
        deeper = [(1, 0, rows)]
        while deeper:
            path, depth, r = deeper.pop()
            if depth == extra or not len(r) or tree.crowded[leaf]:
                out_r.append(r)
                out_l.append(np.full(len(r), (leaf << extra) | (path ^ (1 << depth)), np.int64))
                continue
            u = np.random.default_rng([7, tree.seed, leaf, path]).standard_normal(x.shape[1])
            p = (x[r] - tree.centres[leaf]) @ (u / np.linalg.norm(u))
            deeper += [(path << 1, depth + 1, r[p < margin]), (path << 1 | 1, depth + 1, r[p >= -margin])]
    return np.concatenate(out_r), np.concatenate(out_l)


def valid(label, vector):
    """Column: whether a vector can link at all."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(sound, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def _unit(vectors, dim: int) -> np.ndarray:
    size = vectors.map(len).to_numpy()
    x = np.zeros((len(vectors), dim))
    for n in np.unique(size):
        x[size == n, : min(n, dim)] = np.stack(vectors[size == n].tolist())[:, :dim]
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _leaves(classes: DataFrame, rows: int, trees: int, sample: int, vector: str) -> DataFrame:
    """Classes (node, m, label, vector) once per leaf, with all of a row's leaves."""
    picked = classes.orderBy(F.xxhash64(F.lit(11), "node"), "node").limit(sample).select("vector").toPandas()["vector"]
    dim = max(map(len, picked))
    x = _unit(picked, dim)
    forest = [fit_tree(x, t) for t in range(trees)]
    extra = max(0, math.ceil(math.log2(max(1, rows / (LEAF * min(len(t.centres) for t in forest))))))
    sent = classes.sparkSession.sparkContext.broadcast(forest)  # grows with SAMPLE only
    margin = MARGIN / math.sqrt(dim)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                c = b.iloc[at : at + 2000].reset_index(drop=True)
                x = _unit(c["vector"], dim)
                rows, leaves = [], []
                for k, tree in enumerate(sent.value):
                    r, leaf = route(tree, x, extra, margin)
                    rows.append(r)
                    leaves.append(leaf * trees + k)
                r, leaf = np.concatenate(rows), np.concatenate(leaves)
                order = np.lexsort((leaf, r))
                r, leaf = r[order], leaf[order]
                own = np.split(leaf, np.flatnonzero(np.diff(r)) + 1)
                out = c.iloc[r].reset_index(drop=True)
                out["leaf"] = leaf
                out["leaves"] = [own[i] for i in np.searchsorted(np.unique(r), r)]
                yield out

    return classes.mapInPandas(run, f"node long, m long, label string, vector {vector}, leaf long, leaves array<long>")


def _met(leaves: list[np.ndarray], leaf: int) -> np.ndarray:
    """Matrix (row, lesser leaf that several rows have): two rows with one in common have met before ``leaf``."""
    row, value = np.repeat(np.arange(len(leaves)), [len(v) for v in leaves]), np.concatenate(leaves)
    row, value = row[value < leaf], value[value < leaf]
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = (count > 1)[column]
    met = np.zeros((len(leaves), int((count > 1).sum())), np.float32)
    met[row[shared], (np.cumsum(count > 1) - 1)[column[shared]]] = 1
    return met


def _compare(cosine: float):
    """Of rows (leaf, one, two, block, node, m, label, vector, leaves), sorted by the first three: (node, links, low) of each leaf's pair of blocks."""

    def pair(rows: pd.DataFrame, x: np.ndarray, size: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, ...] | None:
        leaf, one, two = (int(rows[c].iloc[0]) for c in ("leaf", "one", "two"))
        block, node, m = (rows[c].to_numpy() for c in ("block", "node", "m"))
        a = np.flatnonzero(block == one)
        b = a if one == two else np.flatnonzero(block == two)
        near = (x[a] @ x[b].T) >= cosine
        near &= (label[a][:, None] == label[b][None, :]) & (size[a][:, None] == size[b][None, :])
        if one == two:
            np.fill_diagonal(near, False)
        hit = np.zeros(len(rows), bool)
        hit[a[near.any(axis=1)]] = True
        hit[b[near.any(axis=0)]] = True
        if not hit.any():
            return None
        met = np.zeros((len(rows), 0), np.float32)
        sets = _met([np.asarray(v, np.int64) for v in rows["leaves"][hit]], leaf)
        if sets.shape[1]:  # a pair counts in the least leaf that both rows have
            met = np.zeros((len(rows), sets.shape[1]), np.float32)
            met[hit] = sets
            near &= (met[a] @ met[b].T) == 0
        ia, ib = np.nonzero(near)
        ia, ib = a[ia], b[ib]
        links = np.bincount(ia, m[ib], minlength=len(rows))
        if one != two:
            links += np.bincount(ib, m[ia], minlength=len(rows))
        low = node.copy()
        while len(ia):
            new = low.copy()
            np.minimum.at(new, ia, low[ib])
            np.minimum.at(new, ib, low[ia])
            if (new == low).all():
                break
            low = new
        hit = links > 0
        return node[hit], links[hit].astype(np.int64), low[hit]

    def run(rows: pd.DataFrame, cuts: np.ndarray) -> pd.DataFrame:
        rows = rows.reset_index(drop=True)
        size = rows["vector"].map(len).to_numpy()
        x, label = _unit(rows["vector"], int(size.max())), pd.factorize(rows["label"])[0]
        found = [pair(rows.iloc[lo:hi], x[lo:hi], size[lo:hi], label[lo:hi]) for lo, hi in zip(cuts, cuts[1:]) if hi - lo > 1]
        found = [f for f in found if f]
        parts = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("node", "links", "low"), parts)))

    return run


def near_duplicates(rows: DataFrame, cosine: float = COSINE, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """``rows`` (vec_id, embedding, label) to (vec_id, n_links, component_id, kept), one row each."""
    vector = rows.schema["embedding"].dataType.simpleString()
    vector = vector if vector == "array<float>" else "array<double>"  # no component is rounded
    keyed = rows.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast(vector).alias("vector"))
    ok = valid(F.col("label"), F.col("vector"))
    keyed = keyed.select("vec_id", "label", "vector", ok.alias("ok"), F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector", "label").alias("k2"))
    good = keyed.where("ok")
    classes = good.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("vector").alias("vector"))
    classes = stage(classes.withColumn("node", F.coalesce("rep", "k2")), "classes")
    n = classes.count()
    found = None
    if n > 1:
        placed = stage(_leaves(classes.select("node", "m", "label", "vector"), n, trees, sample, vector), "leaves")
        blocks = placed.groupBy("leaf").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("leaf", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        p = placed.join(maybe_broadcast(blocks), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        p = p.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        p = p.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        p = p.withColumns({"one": F.least("block", "other"), "two": F.greatest("block", "other")}).drop("blocks", "other")
        dealt = p.repartition("leaf", "one", "two").sortWithinPartitions("leaf", "one", "two")
        found = stage(dealt.mapInPandas(by_block(_compare(cosine), "leaf", "one", "two"), "node long, links long, low long"), "links")
        comp = connected_components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        classes = classes.join(links, "node", "left").join(comp, "node", "left")
    else:
        classes = classes.withColumns({"links": F.lit(None).cast("long"), "component": F.lit(None).cast("long")})
    classes = classes.withColumns({"links": F.coalesce("links", F.lit(0)) + F.col("m") - 1, "c": F.coalesce("component", "node")})
    lowest = classes.groupBy("c").agg(F.min("rep").alias("component_id"))
    ids = classes.join(lowest, "c").select("label", "k1", "k2", "links", "component_id")
    linked = good.select("vec_id", "label", "k1", "k2").join(ids, ["label", "k1", "k2"]).select("vec_id", F.col("links").alias("n_links"), "component_id")
    alone = keyed.where(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


QUERIES = {"op5_projection_forest": op5_projection_forest}
ORACLE: dict[str, str] = {}
