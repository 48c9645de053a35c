"""k-means by dual-tree Lloyd steps: cover trees over blocks of vectors meet a cover tree over the centroids, all in exact integers.

The blocks, each with its tree and the sums of its nodes, are written once to the shared folder. A round sends the centroids and their tree,
walks each block's tree against it level by level, drops pairs of nodes whose distance bounds rule them out, gives whole nodes to a
centroid by their sums, compares what is left at the leaves exactly, and brings back one sum for each task, cluster and component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SIZE, K, ROUNDS, SCALE = 64, 8, 10, 1024
#: Vectors in a block, and in a leaf of its tree.
BLOCK, LEAF = 1024, 16
#: Components beyond this count as this, so that squared distances of SIZE components fit 64 bits.
LIMIT = 1 << 27
#: Bounds are doubles; a pair is dropped only if it is worse by more than this share.
SLACK = 1e-9


@dataclass
class CoverTree:
    """Nodes in breadth-first order. A node's centre is one of its points, all of which lie within its radius; children halve it.

    order lists the points so that each node has the places start to end of it; child and children name a node's first child and how many.
    """

    order: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    start: np.ndarray
    end: np.ndarray
    child: np.ndarray
    children: np.ndarray


def cover_tree(points: np.ndarray, leaf: int) -> CoverTree:
    """Centres of a node's children are over half its radius apart, each point hangs on one within half of it, and the first is the node's own."""
    order, squares = np.arange(len(points)), lambda i, js: ((points[js] - points[i]) ** 2).sum(axis=1)
    nodes = [(0, 0, len(points))]
    radius, child, children = [], [], []
    for center, start, end in nodes:
        members = order[start:end]
        d = squares(center, members)
        r = math.sqrt(float(d.max())) * (1 + SLACK)
        radius.append(r)
        child.append(len(nodes))
        if len(members) <= leaf or (r == 0 and leaf > 1):
            children.append(0)
            continue
        parts, c, rest = [], center, members
        while len(rest):
            d = squares(c, rest)
            mine = d <= r * r / 4 if r > 0 else rest == c  # equal points of a tree with one point a leaf part all the same
            parts.append((c, rest[mine]))
            rest = rest[~mine]
            c = rest[0] if len(rest) else None
        order[start:end] = np.concatenate([p for _, p in parts])
        for c, p in parts:
            nodes.append((c, start, start + len(p)))
            start += len(p)
        children.append(len(parts))
    center, start, end = (np.array(v, np.int64) for v in zip(*nodes))
    return CoverTree(order, center, np.array(radius), start, end, np.array(child, np.int64), np.array(children, np.int64))


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and value of the ranges that begin at first and have count values each."""
    who = np.repeat(np.arange(len(first)), count)
    return who, first[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors, each to each; by doubles where these hold all values exactly."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < 1 << 22:
        x, y = a.astype(np.float64), b.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T)).astype(np.int64)
    return np.stack([((a - c) ** 2).sum(axis=1) for c in b], axis=1)


def assign(points: np.ndarray, tree: CoverTree, centroids: np.ndarray, ctree: CoverTree) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Whole nodes as (nodes, cluster) pairs; places of order and clusters of the points that were compared one by one."""
    whole: list[tuple[np.ndarray, np.ndarray]] = []
    places, chosen = [], []
    v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
    between = np.sqrt(square_distances(points[tree.center], centroids).astype(np.float64))  # of each node's centre and each centroid
    while len(v):
        d = between[v, ctree.center[c]]
        # A node of centroids has its centre among them, so no point of v is further from its own than this.
        worst = np.full(len(tree.center), np.inf)
        np.minimum.at(worst, v, d + tree.radius[v])
        near = d - tree.radius[v] - ctree.radius[c] <= worst[v] * (1 + SLACK) + SLACK
        v, c = v[near], c[near]
        single, alone = ctree.children[c] == 0, np.bincount(v, minlength=len(tree.center))[v] == 1
        done = single & alone
        whole.append((v[done], ctree.center[c[done]]))
        v, c, single = v[~done], c[~done], single[~done]
        # A leaf goes on until it stands against single centroids only.
        open_nodes = np.zeros(len(tree.center), bool)
        open_nodes[v[~single]] = True
        last = (tree.children[v] == 0) & ~open_nodes[v]
        if last.any():
            rivals = np.zeros((len(tree.center), len(centroids)), bool)
            rivals[v[last], ctree.center[c[last]]] = True
            leaves = np.unique(v[last])
            who, at = spread(tree.start[leaves], (tree.end - tree.start)[leaves])
            far = square_distances(points[tree.order[at]], centroids)
            places.append(at)
            chosen.append(np.where(rivals[leaves[who]], far, np.iinfo(np.int64).max).argmin(axis=1))  # of equals the smallest number
            v, c = v[~last], c[~last]
        who, c2 = spread(np.where(ctree.children[c] == 0, c, ctree.child[c]), np.maximum(ctree.children[c], 1))
        v, c = v[who], c2
        who, v2 = spread(np.where(tree.children[v] == 0, v, tree.child[v]), np.maximum(tree.children[v], 1))
        v, c = v2, c[who]
    empty = np.zeros(0, np.int64)
    return whole, np.concatenate([empty, *places]), np.concatenate([empty, *chosen])


_TREE = ("order", "center", "radius", "start", "end", "child", "children")
_BLOCKS = "ids array<long>, points binary, sums binary, " + ", ".join(f"{name} binary" for name in _TREE)


def quantised(vectors: DataFrame, size: int = SIZE) -> DataFrame:
    """vec_id and the integers floor(1024 * x) of the vectors that have all their components; those beyond LIMIT count as LIMIT."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    kept = vectors.select("vec_id", "embedding").filter((F.size("embedding") == size) & ~F.coalesce(bad, F.lit(True)))
    top = float(LIMIT // SCALE)
    whole = lambda v: F.floor(F.least(F.greatest(v.cast("double"), F.lit(-top)), F.lit(top)) * SCALE).cast("long")
    return kept.select("vec_id", F.transform("embedding", whole).alias("q"))


def blocks(rows: DataFrame, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Blocks of vectors with their trees and the sums of the tree's nodes, as bytes."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), block):
                part = frame.iloc[k : k + block]
                points = np.array(part["q"].tolist(), np.int64)
                tree = cover_tree(points, leaf)
                total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points[tree.order], axis=0)])
                ids = [None if pd.isna(i) else int(i) for i in part["vec_id"]]
                yield pd.DataFrame([{"ids": ids, "points": points.tobytes(), "sums": (total[tree.end] - total[tree.start]).tobytes()} | {n: getattr(tree, n).tobytes() for n in _TREE}])

    return rows.mapInPandas(build, _BLOCKS)


def _opened(row: dict, size: int) -> tuple[np.ndarray, np.ndarray, CoverTree]:
    read = lambda name, kind=np.int64: np.frombuffer(row[name], kind)
    return read("points").reshape(-1, size), read("sums").reshape(-1, size), CoverTree(*(read(n, np.float64 if n == "radius" else np.int64) for n in _TREE))


def round_sums(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, total: the sum of each component of each cluster's vectors, and their number at place -1."""
    ctree, k, size = cover_tree(centroids, 1), *centroids.shape

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, size), np.int64), np.zeros(k, np.int64)
        for frame in frames:
            for row in frame.to_dict("records"):
                points, sums, tree = _opened(row, size)
                whole, places, chosen = assign(points, tree, centroids, ctree)
                for nodes, cluster in whole:
                    np.add.at(total, cluster, sums[nodes])
                    np.add.at(count, cluster, (tree.end - tree.start)[nodes])
                np.add.at(total, chosen, points[tree.order[places]])
                np.add.at(count, chosen, 1)
        rows = np.concatenate([count[:, None], total], axis=1)
        yield pd.DataFrame({"cluster": np.repeat(np.arange(k), size + 1), "place": np.tile(np.arange(-1, size), k), "total": rows.ravel()})

    sums = made.drop("ids").mapInPandas(step, "cluster int, place int, total long")
    return sums.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def assigned(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector."""
    ctree, size = cover_tree(centroids, 1), centroids.shape[1]

    def step(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.to_dict("records"):
                points, _, tree = _opened(row, size)
                whole, places, chosen = assign(points, tree, centroids, ctree)
                cluster = np.zeros(len(points), np.int64)
                cluster[tree.order[places]] = chosen
                for nodes, own in whole:
                    who, at = spread(tree.start[nodes], (tree.end - tree.start)[nodes])
                    cluster[tree.order[at]] = own[who]
                distance = ((points - centroids[cluster]) ** 2).sum(axis=1)
                yield pd.DataFrame({"vec_id": pd.array(list(row["ids"]), dtype="Int64"), "cluster": cluster, "distance": distance})

    return made.mapInPandas(step, "vec_id long, cluster int, distance long")


def lloyd(made: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The centroids after so many rounds. A round brings K * (SIZE + 1) sums to the driver, whatever the number of vectors."""
    for _ in range(rounds):
        sums = {(r["cluster"], r["place"]): int(r["total"]) for r in round_sums(made, centroids).collect()}
        new = centroids.copy()
        for k in range(len(centroids)):
            if n := sums.get((k, -1), 0):
                new[k] = [sums[k, p] // n for p in range(centroids.shape[1])]
        if (new == centroids).all():
            break  # nothing moves any more, so the rounds that are left would repeat this one
        centroids = new
    return centroids


def _long(total: Column) -> Column:
    return F.least(total, F.lit((1 << 63) - 1).cast("decimal(38,0)")).cast("long")


def centroid_clusters(vectors: DataFrame, size: int = SIZE, k: int = K, rounds: int = ROUNDS, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each vector of vectors (vec_id, embedding) that has all its components.

    Vectors that are null, of another length or hold null or non-finite components are left out; repeated rows count each; a null vec_id
    hashes like an empty string, and of equal vec_ids the smaller vector comes first. With fewer than k vectors there are as many
    clusters, with none an empty result. Components beyond 2**27 after scaling count as that, and an inertia beyond 64 bits as the
    largest number there is. Other columns are not read.
    """
    rows = quantised(vectors, size)
    first = rows.orderBy(F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256), "q").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return rows.sparkSession.createDataFrame([], schema)
    made = cut(blocks(rows, block, leaf))
    centroids = lloyd(made, np.array([r["q"] for r in first], np.int64), rounds)
    out = cut(assigned(made, centroids))
    inertia = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    known = rows.sparkSession.createDataFrame([(i, ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())], "cluster int, listed string")
    total = inertia.agg(F.sum("inertia").alias("all"))
    about = known.join(inertia, "cluster").crossJoin(total)  # a row for each cluster, one for all
    about = about.select("cluster", _long(F.col("inertia")).alias("cluster_inertia"), _long(F.col("all")).alias("inertia"), F.sha2("listed", 256).alias("centroid_sha256"))
    return out.join(F.broadcast(about), "cluster").select(*(part.split()[0] for part in schema.split(", ")))
