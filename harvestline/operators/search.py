"""Parameter search for boosters: candidates of a seeded draw, successive halving over folds, scored by WRMSSE."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np

from harvestline.operators.boosting import Params, Training

#: Name, low, high, and how a value is drawn; the ranges are those that the search of the booster covers.
RANGES = [
    ("power", 1.05, 1.6, "even"), ("leaves", 4, 31, "whole"), ("min_rows", 20, 1000, "whole"), ("feature_share", 0.5, 1.0, "even"), ("row_share", 0.5, 1.0, "even"),
    ("l1", 1e-3, 10.0, "log"), ("l2", 1e-3, 10.0, "log"), ("min_gain", 0.0, 0.5, "even"), ("rate", 0.05, 0.3, "log"),
]


@dataclass(frozen=True)
class Fold:
    """Rows whose order is beyond after are learned from; name tells the folds apart."""

    name: str
    after: float


def candidates(n: int, seed: int, default: Params) -> list[Params]:
    """The default and n - 1 drawn ones, named c0, c1, ...; the same for the same seed."""
    rng = np.random.default_rng(seed)
    out = [replace(default, name="c0")]
    for k in range(1, n):
        drawn = {}
        for name, low, high, how in RANGES:
            x = rng.random()
            value = math.exp(math.log(low) + x * (math.log(high) - math.log(low))) if how == "log" else low + x * (high - low)
            drawn[name] = round(value) if how == "whole" else value
        out.append(replace(default, name=f"c{k}", seed=k, **drawn))
    return out


def on_folds(params: list[Params], folds: list[Fold]) -> list[Params]:
    """A booster for each candidate and fold; they grow in step over the same blocks."""
    return [replace(p, name=f"{p.name}@{f.name}", after=f.after) for p in params for f in folds]


def halving(training: Training, names: list[str], folds: list[Fold], rungs: list[int], score: Callable[[Training, list[str]], dict[str, float]]) -> list[tuple[int, str, int, float, bool]]:
    """rung, candidate, trees, mean score, kept: after so many more trees each, the better half goes on; the last rung keeps one.

    Trees are never grown anew: a candidate that goes on adds to those that it has. Ties go to the earlier name.
    """
    alive, trees, log = list(names), 0, []
    for rung, more in enumerate(rungs, 1):
        of = {c: [f"{c}@{f.name}" for f in folds] for c in alive}
        training.grow(more, only={b for bs in of.values() for b in bs})
        trees += more
        found = score(training, [b for bs in of.values() for b in bs])
        mean = {c: float(np.mean([found.get(b, math.inf) for b in bs])) for c, bs in of.items()}
        best = sorted(alive, key=lambda c: (mean[c], names.index(c)))
        keep = best[: 1 if rung == len(rungs) else math.ceil(len(best) / 2)]
        log += [(rung, c, trees, mean[c], c in keep) for c in alive]
        alive = [c for c in alive if c in keep]
    return log
