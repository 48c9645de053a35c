"""Near-duplicate vectors against brute force: links, components, copies, awkward rows, recall at the similarity that counts."""

import collections

import numpy as np
import pytest

from harvestline.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, node string, x int"


def brute(rows, cosine=0.9):
    """n_links and component of each row by comparing all pairs."""
    good = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if g else None for g, (_, v) in zip(good, rows)]
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        return i if root[i] == i else find(root[i])

    for i, a in enumerate(unit):
        for j, b in enumerate(unit[:i]):
            if a is not None and b is not None and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [(k, n, low.get(find(i)), k is not None and k == low.get(find(i))) for i, ((k, _), n) in enumerate(zip(rows, links))]


def outcome(spark, rows, **how):
    data = [(k, None if v is None else [None if c is None else float(c) for c in v], 0, "n", 1) for k, v in rows]
    got = forest.embedding_near_dedup(spark.createDataFrame(data, SCHEMA).repartition(3), **how)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return [tuple(r) for r in got.collect()]


def clusters(seed, n, size, near):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        v = rng.standard_normal(size)
        rows.append(v)
        for _ in range(rng.integers(0, 4)):
            v = v + near * rng.standard_normal(size)
            rows.append(v)
    return [(int(i), v.astype(np.float32).tolist()) for i, v in zip(rng.permutation(len(rows)), rows)]


def test_chains_copies_and_awkward_rows_equal_brute_force(spark):
    rows = clusters(1, 40, 8, 0.2)
    nan, inf = float("nan"), float("inf")
    rows += [(900, rows[0][1]), (901, rows[0][1]), (902, [0.0] * 8), (903, [0.0] * 8), (904, None), (905, []), (906, [1.0] * 7), (907, [2.0] * 7), (908, [nan] * 8), (909, [inf] + [0.0] * 7)]
    rows += [(910, [None] + [1.0] * 7), (7, rows[3][1]), (7, [-c for c in rows[3][1]]), (None, rows[5][1]), (None, None), (911, [3e38] * 8), (912, [1e-38] * 8), (913, [-0.0] + [1.0] * 7), (914, [0.0] + [1.0] * 7)]
    want = brute(rows)
    assert sum(n for _, n, _, _ in want) > 40
    assert collections.Counter(outcome(spark, rows)) == collections.Counter(want)


def test_a_leaf_larger_than_a_tile_is_compared_whole(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal(16)
    rows = [(i, (middle + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()) for i in range(150)] + clusters(3, 30, 16, 0.1)
    rows = [(i, v) for i, (_, v) in enumerate(rows)]
    assert collections.Counter(outcome(spark, rows, tile=20)) == collections.Counter(brute(rows))


def test_a_pair_is_counted_once_over_all_trees(spark):
    rows = clusters(4, 120, 16, 0.03)
    got, want = outcome(spark, rows, leaf=8), brute(rows)
    assert collections.Counter(got) == collections.Counter(want) and sum(n for _, n, _, _ in want) > 100


@pytest.mark.parametrize("leaf", [16, 128])
def test_recall_of_partners_at_the_limit(spark, leaf):
    """Half of the vectors have one partner at a cosine just over 0.9, the hardest that there are."""
    rng = np.random.default_rng(5)
    x = forest.unit(rng.standard_normal((1500, 64)))
    aside = rng.standard_normal(x.shape)
    aside = forest.unit(aside - np.sum(aside * x, axis=1, keepdims=True) * x)
    y = 0.901 * x + np.sqrt(1 - 0.901**2) * aside
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, y]).astype(np.float32))]
    got = outcome(spark, rows, leaf=leaf)
    want = {k: n for k, n, _, _ in brute(rows)}
    assert all(n <= want[k] for k, n, _, _ in got)
    assert sum(n for _, n, _, _ in got) >= 0.97 * sum(want.values())


def test_empty_table(spark):
    assert outcome(spark, []) == []
