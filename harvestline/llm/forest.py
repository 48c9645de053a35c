"""Near-duplicate vectors: a forest of random-projection trees with spill, exact comparison within leaves, and union of what is linked.

Each tree splits the unit vectors level by level along random directions at medians; a vector within SPILL of a cut goes to both sides.
Trees are added until partners at the very similarity that counts, drawn at random, share a leaf of some tree with probability 1 - MISS.
The trees are fitted on a bounded sample; every vector goes down every tree, and the depth follows the number of vectors, so leaves stay
small at any size. A leaf that is larger than a tile all the same is compared in pairs of tiles, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .simhash import components

COSINE = 0.9
#: Vectors that a leaf holds on average before spill, and those of one side of a comparison.
LEAF, TILE = 256, 1024
#: Vectors that the trees are fitted on, and levels of which each node has a cut of its own; below, nodes share those of their ancestor there.
SAMPLE, TOP = 16_384, 10
#: Width of the spill in standard deviations of the projected difference of two vectors at COSINE.
SPILL = 0.25
#: Partners at COSINE that may share no leaf; most trees.
MISS, MOST_TREES = 0.005, 128
SEED = 20_011


@dataclass
class Forest:
    """Trees for vectors of one length: directions (size x depth) and, for each level, the cuts of its nodes."""

    planes: list[np.ndarray]
    cuts: list[list[np.ndarray]]
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and leaf of each place that a unit vector of x has in the forest."""
        rows, codes = [], []
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts)):
            at, code, shadow = np.arange(len(x)), np.zeros(len(x), np.int64), x @ planes
            for level, cut_of in enumerate(cuts):
                over = shadow[at, level] - cut_of[code >> max(level - TOP, 0)]
                left, right = over < self.margin, over >= -self.margin
                at, code = np.concatenate([at[left], at[right]]), np.concatenate([2 * code[left], 2 * code[right] + 1])
            rows.append(at)
            codes.append(code + (t << 48))
        return np.concatenate(rows), np.concatenate(codes)


def fit_forest(sample: np.ndarray, depth: int, cosine: float = COSINE, miss: float = MISS) -> Forest:
    """Trees of this depth over the sample's unit vectors, as many as partners at the cosine need."""
    rng, size = np.random.default_rng([SEED, sample.shape[1]]), sample.shape[1]
    forest = Forest([], [], SPILL * math.sqrt((2 - 2 * cosine) / size))
    ours = sample[rng.permutation(len(sample))[:2048]]
    aside = rng.standard_normal(ours.shape)
    aside -= np.sum(aside * ours, axis=1, keepdims=True) * ours
    partners = cosine * ours + math.sqrt(1 - cosine * cosine) * aside / np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
    apart = np.ones(len(ours), bool)
    while apart.mean() > miss and len(forest.planes) < MOST_TREES:
        planes = rng.standard_normal((size, depth)) / math.sqrt(size)
        shadow, code, cuts = sample @ planes, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            node = code >> max(level - TOP, 0)
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange((1 << min(level, TOP)) + 1))
            cuts.append(np.array([np.median(shadow[order[a:b], level]) if b > a else 0.0 for a, b in zip(edges, edges[1:])]))
            code = 2 * code + (shadow[:, level] >= cuts[-1][node])
        tree = Forest([planes], [cuts], forest.margin)
        here = [set(zip(*(v.tolist() for v in tree.leaves(x)))) for x in (ours, partners)]
        apart[[row for row, _ in here[0] & here[1]]] = False
        forest.planes.append(planes)
        forest.cuts.append(cuts)
    return forest


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that neither huge nor tiny components spoil the length."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def first_links(x: np.ndarray, sides: np.ndarray, leaf: int, owner: np.ndarray, leaves: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (rows of x) of two tiles, or of one with itself, that share no earlier leaf: a pair is found in one place only.

    owner and leaves are the rows' other places in the forest, a bit set of the leaves before this one for each row.
    """
    left = np.flatnonzero(sides != 1)
    right = np.flatnonzero(sides == 1) if (sides == 1).any() else left
    near = x[left] @ x[right].T >= cosine
    a, b = np.nonzero(np.triu(near, 1) if right is left else near)
    i, j = left[a], right[b]
    earlier = leaves < leaf
    known, place = np.unique(leaves[earlier], return_inverse=True)
    bits = np.zeros((len(x), len(known) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner[earlier], place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    step = 1 << 16
    fresh = [~(bits[i[k : k + step]] & bits[j[k : k + step]]).any(axis=1) for k in range(0, len(i), step)]
    fresh = np.concatenate(fresh) if fresh else np.zeros(0, bool)
    return i[fresh], j[fresh]


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest row that each of n rows reaches over the pairs."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def leaf_links(classes: DataFrame, forests: dict[int, Forest], kind: str, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """node, links (copies of the other side counted), root: the links of each comparison, summed up by node; root is a node that it reaches.

    classes has node, x (arrays of the numpy type kind) and n, its number of copies. Vectors of different lengths never meet.
    """
    sent = classes.sparkSession.sparkContext.broadcast(forests)  # bounded: SAMPLE and TOP bound a tree's cuts, MOST_TREES their number

    def places(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            lengths = frame["x"].map(len).to_numpy()
            for size in np.unique(lengths):
                own = frame[lengths == size].reset_index(drop=True)
                raw = np.array(own["x"].tolist(), dtype=kind)
                forest = sent.value.get(int(size)) or Forest([np.zeros((size, 0))], [[]], 0.0)
                row, leaf = forest.leaves(unit(raw))
                order = np.lexsort((leaf, row))
                row, leaf = row[order], leaf[order]
                ends = np.searchsorted(row, np.arange(len(own) + 1))
                all_leaves = [leaf[a:b].tobytes() for a, b in zip(ends, ends[1:])]
                packed = [v.tobytes() for v in raw]
                yield pd.DataFrame({
                    "node": own["node"].to_numpy()[row], "n": own["n"].to_numpy()[row], "size": int(size), "leaf": leaf,
                    "x": [packed[r] for r in row], "leaves": [all_leaves[r] for r in row],
                })

    rows = classes.select("node", "n", "x").mapInPandas(places, "node long, n long, size int, leaf long, x binary, leaves binary")
    rows = cut(rows)  # the sizes of the leaves come first, then the rows again
    counts = rows.groupBy("size", "leaf").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    rows = rows.join(counts.withColumn("tiles", F.ceil(F.col("members") / tile).cast("int")), ["size", "leaf"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    rows = rows.select("size", "leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), side.alias("side"), "node", "n", "x", "leaves")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.frombuffer(b"".join(frame["x"]), dtype=kind).reshape(len(frame), -1))
        leaves = np.frombuffer(b"".join(frame["leaves"]), np.int64)
        owner = np.repeat(np.arange(len(frame)), frame["leaves"].map(len).to_numpy() // 8)
        i, j = first_links(x, frame["side"].to_numpy(), int(frame["leaf"].iat[0]), owner, leaves, cosine)
        node, n, links = frame["node"].to_numpy(), frame["n"].to_numpy(), np.zeros(len(frame), np.int64)
        np.add.at(links, i, n[j])
        np.add.at(links, j, n[i])
        hit = links > 0
        return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[roots(len(frame), i, j)][hit]})

    return rows.groupBy("size", "leaf", "a", "b").applyInPandas(compare, "node long, links long, root long")


def embedding_near_dedup(vectors: DataFrame, cosine: float = COSINE, leaf: int = LEAF, tile: int = TILE, miss: float = MISS) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors (vec_id, embedding).

    Equal vectors are one class and cost one comparison; each row's n_links counts its copies and all rows of the classes linked with its
    own. Vectors that are null, empty, zero or hold null or non-finite components have no link and stay; so do vectors of different lengths
    towards each other. A repeated vec_id is a row like any other; a null vec_id is linked and counted, but names no component: its
    component is the smallest vec_id there is, null if there is none. A row is kept if it has its component's vec_id. Other columns
    are not read.
    """
    rows = vectors.select("vec_id", F.col("embedding").alias("x"))
    kind = "<f4" if dict(rows.dtypes)["x"] == "array<float>" else "<f8"
    rows = rows if kind == "<f4" else rows.withColumn("x", F.col("x").cast("array<double>"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("x", lambda v: v != 0)
    classes = rows.filter(usable).groupBy("x").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    total, sample = classes.count(), classes.orderBy(F.xxhash64("x"), "node").limit(SAMPLE).select("x").collect()
    by_size: dict[int, list] = {}
    for (x,) in sample:
        by_size.setdefault(len(x), []).append(x)
    forests = {}
    for size, xs in by_size.items():
        depth = max(0, math.ceil(math.log2(total * len(xs) / len(sample) / leaf)))
        forests[size] = fit_forest(unit(np.array(xs, dtype=kind)), depth, cosine, miss)
    found = cut(leaf_links(classes, forests, kind, cosine, tile))
    joined = components(found.filter("node != root").select(F.col("node").alias("src"), F.col("root").alias("dst")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
    known = named.join(lows, "root").select("x", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.filter(usable).join(known, "x").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
