"""Dual-tree clustering against plain Lloyd steps in Python integers, and against its SQL."""

import collections
import hashlib
import math

import duckdb
import numpy as np
import pytest

from harvestline.llm import dual_tree
from harvestline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def brute(rows, size, k, rounds):
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in first[:k]]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [nearest(q)[1] for _, q in kept]
        for j in range(len(centroids)):
            own = [q for (_, q), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]
    found = [(i, *nearest(q)) for i, q in kept]
    inertia = collections.Counter()
    for _, d, j in found:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return collections.Counter((i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in found)


def outcome(spark, rows, **how):
    data = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x") for i, v in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, cluster int, q string").repartition(3)
    return collections.Counter(tuple(r) for r in dual_tree.centroid_clusters(df, **how).collect())


def cloud(seed, n, size, groups, near):
    rng = np.random.default_rng(seed)
    middles = rng.standard_normal((groups, size))
    return [(i, (middles[i % groups] + near * rng.standard_normal(size)).tolist()) for i in range(n)]


@pytest.mark.parametrize("near", [0.0, 0.02, 0.5])
def test_equals_plain_lloyd(spark, near):
    rows = cloud(1, 400, 6, 5, near)
    assert outcome(spark, rows, size=6, k=4, block=100, leaf=4) == brute(rows, 6, 4, 10)


def test_awkward_rows_ties_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(2, 30, 3, 2, 0.1) + [(100, None), (101, []), (102, [1.0, 2.0]), (103, [nan, 0.0, 0.0]), (104, [0.0, -inf, 0.0]), (105, [None, 0.0, 0.0])]
    rows += [(7, [0.5, 0.5, 0.5])] * 5 + [(None, [-0.0, 1e-9, -1e-9])] * 3 + [(200 + i, [float(i % 2), 0.0, 0.0]) for i in range(20)]
    assert outcome(spark, rows, size=3, k=8, block=16, leaf=2) == brute(rows, 3, 8, 10)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0]), (2, [-1.0, 0.5])]
    assert outcome(spark, rows, size=2) == brute(rows, 2, 8, 10)
    assert outcome(spark, [(1, None)], size=2) == collections.Counter()


def test_huge_components_count_as_the_limit(spark):
    got = outcome(spark, [(1, [1e300, 0.0]), (2, [float(1 << 17), 0.0]), (3, [-1e300, 1e300])], size=2, k=1, rounds=0)
    assert sorted((i, d) for i, _, d, _, _, _ in got) in ([(1, 0), (2, 0), (3, 5 << 54)], [(1, 5 << 54), (2, 5 << 54), (3, 0)])


def test_trees_cover_and_part():
    points = np.random.default_rng(3).integers(-50, 50, (300, 3))
    tree = dual_tree.cover_tree(points, 4)
    assert sorted(tree.order) == list(range(300))
    for v in range(len(tree.center)):
        mine = points[tree.order[tree.start[v] : tree.end[v]]]
        assert np.sqrt(((mine - points[tree.center[v]]) ** 2).sum(axis=1)).max() <= tree.radius[v]
        kids = range(tree.child[v], tree.child[v] + tree.children[v])
        assert not kids or (tree.center[kids[0]] == tree.center[v] and sum(tree.end[c] - tree.start[c] for c in kids) == tree.end[v] - tree.start[v])
        apart = [((points[tree.center[a]] - points[tree.center[b]]) ** 2).sum() for a in kids for b in kids if a < b]
        assert all(d > tree.radius[v] ** 2 / 4 for d in apart)


def test_bounds_prune(spark):
    """Far clusters are given away as whole nodes, not point by point."""
    points = np.array([[1024 * int(c) for c in v] for _, v in cloud(4, 500, 4, 3, 0.0)]) * 50 + np.random.default_rng(5).integers(-5, 5, (500, 4))
    centroids = points[:3].copy()
    whole, places, _ = dual_tree.assign(points, dual_tree.cover_tree(points, 8), centroids, dual_tree.cover_tree(centroids, 1))
    assert len(places) == 0 and sum(len(nodes) for nodes, _ in whole) <= 10


def test_query_equals_sql(spark):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    got = QUERIES["op12_centroid_clustering"](spark, SF)
    want = duck.sql(ORACLES["op12_centroid_clustering"])
    assert want.columns == got.columns
    assert collections.Counter(want.fetchall()) == collections.Counter(tuple(r) for r in got.collect())
