"""Boosted trees against a brute-force tree on the raw rows, leaf quantiles, categories, lockstep and shares."""

import math

import numpy as np
import pytest

from harvestline.operators import boosting as G


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 3000
    a, b = rng.integers(0, 12, n).astype(float), rng.integers(0, 8, n).astype(float)
    c = rng.integers(0, 6, n)
    mean = np.exp(0.2 * (a > 5) + 0.4 * (b > 2) * (a <= 5) + 0.8 * np.isin(c, [1, 4]))
    y = rng.poisson(mean * 3).astype(float)
    a[rng.random(n) < 0.1] = np.nan
    return a, b, c, y, rng.random(n) + 0.5


@pytest.fixture(scope="module")
def frame(spark, data):
    rows = [(None if math.isnan(x) else float(x), float(z), f"k{k}", float(y), float(w), i % 2) for i, (x, z, k, y, w) in enumerate(zip(*data))]
    return spark.createDataFrame(rows, "a double, b double, c string, label double, weight double, half int").repartition(5).cache()


def trained(frame, *params, trees=1, order=None):
    return G.Training(frame, G.fit_binning(frame, ["a", "b"], ["c"], 0.0), list(params), order=order).grow(trees)


def brute_splits(g, h, rows, features, p):
    """The best of all splits of a set of rows by thresholds, missing first, or by categories in the order of their ratio."""
    part = lambda r: (g[r].sum() ** 2) / (h[r].sum() + p.l2)
    best = (-math.inf, None, None)
    for name, x in features.items():
        if x.dtype.kind == "f":
            sides = [np.isnan(x)] + [np.isnan(x) | (x <= t) for t in np.unique(x[~np.isnan(x)])]
        else:
            order = sorted(set(x[rows]), key=lambda k: g[rows & (x == k)].sum() / (h[rows & (x == k)].sum() + p.l2))
            sides = [np.isin(x, order[: k + 1]) for k in range(len(order))]
        for left in sides:
            l, r = rows & left, rows & ~left
            if l.sum() >= p.min_rows and r.sum() >= p.min_rows:
                gain = part(l) + part(r) - part(rows)
                if gain > best[0] + 1e-9:
                    best = (gain, l, r)
    return best


@pytest.mark.parametrize("objective", ["tweedie", "l2"])
def test_one_tree_equals_brute_force(frame, data, objective):
    a, b, c, y, w = data
    p = G.Params(objective=objective, depth=3, min_rows=50, rate=1.0)
    model = trained(frame, p).model()
    mean = (w * y).sum() / w.sum()
    base = math.log(mean) if objective == "tweedie" else mean
    assert model.boosters[0].base == pytest.approx(base)
    g, h = G.gradients(p, y, w, np.full(len(y), base))
    raw = np.full(len(y), np.nan)

    def grow(rows, depth):
        gain, left, right = brute_splits(g, h, rows, {"a": a, "b": b, "c": c}, p) if depth else (-math.inf, None, None)
        if gain > 0:
            grow(left, depth - 1)
            grow(right, depth - 1)
        else:
            raw[rows] = base - g[rows].sum() / (h[rows].sum() + p.l2)

    grow(np.ones(len(y), bool), 3)
    want = np.exp(raw) if objective == "tweedie" else raw
    import pandas as pd

    bins = model.binning.matrix(pd.DataFrame({"a": a, "b": b, "c": [f"k{k}" for k in c]}))
    assert np.allclose(model.boosters[0].predict(bins), want)
    got = model.transform(frame).select("label", "point").collect()
    assert np.allclose(sorted((r["label"], r["point"]) for r in got), sorted(zip(y, want)))
    assert sum(model.gains("point").values()) == pytest.approx(100)


def test_quantile_leaves_are_quantiles_of_their_rows(frame, data):
    a, b, c, y, w = data
    low, high = (G.Params(name, "quantile", alpha=q, depth=2, min_rows=100, rate=1.0) for name, q in (("low", 0.1), ("high", 0.9)))
    model = trained(frame, low, high).model()
    import pandas as pd

    bins = model.binning.matrix(pd.DataFrame({"a": a, "b": b, "c": [f"k{k}" for k in c]}))
    for booster, q in zip(model.boosters, (0.1, 0.9)):
        assert booster.base == G.weighted_quantile(y, w, q)
        node, got = booster.trees[0].nodes(bins), booster.predict(bins)
        assert len(set(node)) > 2
        for k in set(node):
            own = node == k
            cum = sorted(zip(y[own], w[own]))
            total, want = 0.0, None
            for value, weight in cum:
                total += weight
                if total >= q * w[own].sum():
                    want = value
                    break
            assert got[own] == pytest.approx(want)


def test_boosters_in_step_are_what_they_are_alone(frame):
    """Shared passes, rewritten scores, shares of rows and features change nothing."""
    some = [G.Params("one", depth=3, row_share=0.7, feature_share=0.7, seed=3), G.Params("two", "l2", depth=2, min_rows=20, leaves=3), G.Params("three", "quantile", alpha=0.8, depth=2, after=0.0, without=("c",))]
    together = trained(frame, *some, trees=10, order="half").model()
    for p, mine in zip(some, together.boosters):
        alone = trained(frame, p, trees=10, order="half").model().boosters[0]
        assert alone.base == pytest.approx(mine.base)
        for s, t in zip(alone.trees, mine.trees):
            assert (s.split == t.split).all() and (s.feature == t.feature).all() and np.allclose(s.value, t.value)
    assert all(t.split.sum() <= 2 for t in together.boosters[1].trees)
    assert together.gains("three")["c"] == 0.0


def test_boosting_comes_close_to_the_mean(frame, data):
    a, b, c, y, w = data
    model = trained(frame, G.Params(depth=3, rate=0.3), G.Params("p90", "quantile", alpha=0.9, depth=3, rate=0.3), trees=25).model()
    got = np.array([(r["label"], r["point"], r["p90"], r["a"] if r["a"] is not None else math.nan, r["b"], int(r["c"][1:])) for r in model.transform(frame).collect()])
    known = ~np.isnan(got[:, 3])
    true = 3 * np.exp(0.2 * (got[:, 3] > 5) + 0.4 * (got[:, 4] > 2) * (got[:, 3] <= 5) + 0.8 * np.isin(got[:, 5], [1, 4]))
    assert np.abs(got[known, 1] / true[known] - 1).mean() < 0.08
    assert 0.87 < (got[:, 0] <= got[:, 2]).mean() < 0.96


def test_no_rows_nulls_and_constant_features(spark, frame):
    empty = G.Training(frame.limit(0), G.fit_binning(frame, ["a"], ["c"]), [G.Params(), G.Params("q", "quantile")]).grow(1).model()
    assert empty.transform(frame.limit(3)).select("point", "q").distinct().count() == 1
    same = spark.createDataFrame([(None, None, 2.0, 1.0), (None, None, 4.0, 1.0), (1.0, "x", None, 1.0), (1.0, "x", 9.0, 0.0)], "a double, c string, label double, weight double")
    model = G.Training(same, G.fit_binning(same, ["a"], ["c"]), [G.Params("m", "l2", min_rows=1)]).grow(2).model()
    assert {r["m"] for r in model.transform(same).collect()} == {3.0}


def test_a_summary_keeps_ranks():
    rng = np.random.default_rng(1)
    x, w = rng.standard_normal(50_000), rng.random(50_000)
    v, u = G.summary(x, w, 512)
    assert len(v) == 512 and u.sum() == pytest.approx(w.sum())
    for q in (0.1, 0.5, 0.9):
        assert w[x <= G.weighted_quantile(v, u, q)].sum() / w.sum() == pytest.approx(q, abs=2 / 512)


def test_rows_walk_to_the_leaves_of_uneven_trees():
    rng = np.random.default_rng(8)
    bins = rng.integers(0, G.BINS, (500, 5)).astype(np.uint8)
    for splits in ([], [0], [0, 2], [0, 1, 4, 9], [0, 2, 5, 6, 12, 13]):
        tree = G.Tree.root(4)
        tree.split[splits] = True
        tree.feature[:], tree.left[:] = rng.integers(0, 5, len(tree.split)), rng.random(tree.left.shape) < 0.5
        want = []
        for row in bins:
            k = 0
            while tree.split[k]:
                k = 2 * k + (1 if tree.left[k, row[tree.feature[k]]] else 2)
            want.append(k)
        assert tree.nodes(bins).tolist() == want and tree.nodes(bins[:, ::-1][:, ::-1]).tolist() == want
        assert tree.nodes(bins[:0]).tolist() == []
