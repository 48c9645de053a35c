"""Candidates, successive halving, and that a search's choice is better than a poor default."""

import math

import numpy as np

from harvestline.operators import boosting as G
from harvestline.operators import search as S


def test_candidates_are_the_same_for_a_seed():
    a, b, c = (S.candidates(6, seed, G.Params(depth=3)) for seed in (1, 1, 2))
    assert a == b != c and [p.name for p in a] == [f"c{k}" for k in range(6)] and a[0] == G.Params("c0", depth=3)
    for name, low, high, _ in S.RANGES:
        assert all(low <= getattr(p, name) <= high for p in a[1:])


def test_halving_keeps_the_better_half_and_grows_on(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 20, 4000)
    y = rng.poisson(np.exp(0.15 * x)).astype(float)
    frame = spark.createDataFrame([(float(a), float(b), 1.0, float(k % 3)) for k, (a, b) in enumerate(zip(x, y))], "a double, label double, weight double, part double").cache()
    default = G.Params(rate=0.01, depth=2, min_rows=20)  # learns far too slowly
    tried, folds = S.candidates(4, 3, default), [S.Fold("one", 0.0), S.Fold("two", 1.0)]

    def score(training, names):
        rows = training.model().transform(frame, {n: f"p{k}" for k, n in enumerate(names)}).toPandas()
        return {n: float(np.sqrt(((rows[f"p{k}"] - np.exp(0.15 * rows["a"])) ** 2).mean())) for k, n in enumerate(names)}

    def run():
        training = G.Training(frame, G.fit_binning(frame, ["a"], []), S.on_folds(tried, folds), order="part")
        return S.halving(training, [p.name for p in tried], folds, [2, 2, 3], score), training

    (log, training), (again, _) = run(), run()
    assert log == again
    assert [sum(r == k for r, *_ in log) for k in (1, 2, 3)] == [4, 2, 1] and {t for _, _, t, _, _ in log} == {2, 4, 7}
    last = log[-1]
    first = {c: s for r, c, _, s, _ in log if r == 1}
    assert last[4] and last[1] != "c0" and last[3] < first["c0"] and math.isfinite(last[3])
    assert {c for r, c, _, _, kept in log if r == 1 and kept} == set(sorted(first, key=first.get)[:2])
    grown = {b.params.name: sum(t.split.any() for t in b.trees) for b in training.boosters}
    assert grown[f"{last[1]}@one"] == 7 and all(len(b.trees) == 7 for b in training.boosters)
