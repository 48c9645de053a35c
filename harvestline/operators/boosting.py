"""Gradient-boosted trees on binned features, several boosters in step.

Rows are binned once and kept as blocks of bytes in the shared folder. One Spark job grows one level of one tree of every booster: tasks sum
gradients and hessians of their blocks by (booster, node, feature, bin), a shuffle adds these up and finds each feature's best split, and
the driver sees the best split of each node, never histograms or rows. Since boosters share the passes, a Tweedie booster, its quantile
boosters, the candidates of a search and the variants of an ablation cost as many jobs together as one alone.

Objectives: tweedie (logarithmic link), l2, and quantile, whose leaves are set to the quantile of their residuals. Numeric splits send the
smaller values and the missing ones (bin 0) to the left; categories are ordered by gradient over hessian and split there.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestline.sources.shared import cut

#: Bins of a feature, the missing one included; rows in a block; trees after which the rows' scores are written anew.
BINS, BLOCK, REFRESH = 64, 16_384, 8
#: Points that stand for the residuals of a leaf; the rank of a quantile is off by less than 2 in so many.
POINTS = 2048


@dataclass(frozen=True)
class Params:
    """One booster. after: only rows whose order is beyond it are learned from; without: features that it does without; weighted: by the rows' weights."""

    name: str = "point"
    objective: str = "tweedie"
    power: float = 1.1
    alpha: float = 0.5
    rate: float = 0.1
    depth: int = 5
    leaves: int = 31
    min_rows: int = 100
    l1: float = 0.0
    l2: float = 0.1
    min_gain: float = 0.0
    feature_share: float = 1.0
    row_share: float = 1.0
    seed: int = 0
    after: float = -math.inf
    without: tuple[str, ...] = ()
    weighted: bool = True


@dataclass
class Tree:
    """A binary tree in heap order: node k has the children 2k + 1 and 2k + 2; left tells which bins of its feature go left."""

    split: np.ndarray
    feature: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def root(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.zeros(n, bool), np.zeros(n, np.int64), np.zeros((n, BINS), bool), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node, without children, that each row comes to."""
        at = np.zeros(len(bins), np.int64)
        inner = np.flatnonzero(self.split)
        if len(inner) == 0 or len(bins) == 0:
            return at
        # Where a row goes from a node by its bin: to itself if the node has no children. So a level is three look-ups, without masks.
        to = np.repeat(np.arange(len(self.split)), BINS).reshape(-1, BINS)
        to[inner] = 2 * inner[:, None] + 2 - self.left[inner]
        to, flat, first = to.ravel(), np.ascontiguousarray(bins).ravel(), np.arange(len(bins)) * bins.shape[1]
        for _ in range(int(inner[-1] + 1).bit_length()):  # the level of the deepest split, and one more
            at = to.take(at * BINS + flat.take(first + self.feature.take(at)))
        return at


@dataclass
class Booster:
    params: Params
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def raw(self, bins: np.ndarray, first: int = 0) -> np.ndarray:
        """What the trees from the first on add up to."""
        out = np.zeros(len(bins))
        for tree in self.trees[first:]:
            out += tree.value[tree.nodes(bins)] if tree.split[0] else tree.value[0]
        return out

    def predict(self, bins: np.ndarray) -> np.ndarray:
        raw = self.base + self.raw(bins)
        return np.exp(np.minimum(raw, 50.0)) if self.params.objective == "tweedie" else raw


@dataclass
class Binning:
    """How features become bins: edges of numbers, known values of categories; 0 is missing, unknown or rare."""

    numeric: dict[str, list[float]]
    categories: dict[str, list[str]]

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.categories]

    def columns(self) -> list[Column]:
        return [*(F.col(c).cast("double").alias(c) for c in self.numeric), *(F.col(c).cast("string").alias(c) for c in self.categories)]

    def matrix(self, frame: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(frame), len(self.features)), np.uint8)
        for k, (name, edges) in enumerate(self.numeric.items()):
            x = frame[name].to_numpy(np.float64, na_value=np.nan)
            out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges, x, side="left"))
        for k, (name, values) in enumerate(self.categories.items(), len(self.numeric)):
            known = {v: j for j, v in enumerate(values, 1)}
            out[:, k] = [known.get(v, 0) for v in frame[name]]
        return out


def fit_binning(frame: DataFrame, numeric: list[str], categories: list[str], error: float = 0.002) -> Binning:
    """Edges at quantiles by a mergeable sketch (rank error as given), the most frequent values of each category; both small by BINS."""
    share = [k / (BINS - 1) for k in range(1, BINS - 1)]
    doubles = frame.select(*(F.col(c).cast("double").alias(c) for c in numeric))
    edges = dict(zip(numeric, doubles.approxQuantile(numeric, share, error))) if numeric else {}
    if categories:
        long = frame.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in categories))).alias("x")).select("x.*")
        counts = long.filter("value is not null").groupBy("name", "value").count()
        top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("count"), "value"))).filter(F.col("rank") < BINS)
        found = top.orderBy("name", "rank").collect()
    known = {c: [r["value"] for r in found if r["name"] == c] for c in categories}
    return Binning({c: sorted(set(v)) for c, v in edges.items()}, known)


@dataclass
class Block:
    bins: np.ndarray
    label: np.ndarray
    weight: np.ndarray
    order: np.ndarray
    score: np.ndarray
    block: int


_BLOCK = "block long, bins binary, label binary, weight binary, order binary, score binary"


def blocks(frame: DataFrame, binning: Binning, n_boosters: int, label: str, weight: str, order: str | None) -> DataFrame:
    """Blocks of binned rows; a row without label or weight teaches nothing and is left out."""
    when = F.col(order).cast("double") if order else F.lit(0.0)
    rows = frame.select(*binning.columns(), F.col(label).cast("double").alias("__y"), F.col(weight).cast("double").alias("__w"), when.alias("__o"))
    rows = rows.filter("__y is not null and __w >= 0").withColumn("__at", F.monotonically_increasing_id())
    rows = rows.repartition(max(frame.sparkSession.sparkContext.defaultParallelism, frame.rdd.getNumPartitions()), "__at")  # every pass reads the blocks: even shares

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), BLOCK):
                part = frame.iloc[k : k + BLOCK]
                arrays = {"bins": binning.matrix(part), "label": part["__y"].to_numpy(), "weight": part["__w"].to_numpy(), "order": part["__o"].to_numpy(), "score": np.zeros((n_boosters, len(part)))}
                yield pd.DataFrame([{"block": int(part["__at"].iat[0])} | {c: np.ascontiguousarray(a).tobytes() for c, a in arrays.items()}])

    return rows.mapInPandas(build, _BLOCK)


def _open(row: dict, n_features: int, n_boosters: int) -> Block:
    read = lambda name: np.frombuffer(row[name], np.float64)
    return Block(np.frombuffer(row["bins"], np.uint8).reshape(-1, n_features), read("label"), read("weight"), read("order"), read("score").reshape(n_boosters, -1), row["block"])


def gradients(p: Params, y: np.ndarray, w: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted loss by the score."""
    if p.objective == "tweedie":
        a, b = np.exp((1 - p.power) * score), np.exp((2 - p.power) * score)
        return w * (b - y * a), w * ((2 - p.power) * b - (1 - p.power) * y * a)
    if p.objective == "l2":
        return w * (score - y), w
    return w * np.where(y <= score, 1 - p.alpha, -p.alpha), w


def _weights(p: Params, b: Block) -> np.ndarray:
    return b.weight if p.weighted else np.ones(len(b.weight))


def _taught(p: Params, b: Block, n_trees: int) -> np.ndarray:
    """Rows that a booster's next tree learns from; the draw depends on the tree, the seed and the block only."""
    rows = b.order > p.after
    if p.row_share < 1:
        rows &= np.random.default_rng([p.seed, n_trees, b.block]).random(len(rows)) < p.row_share
    return rows


def best_split(g: np.ndarray, h: np.ndarray, n: np.ndarray, p: Params, categorical: bool) -> tuple[float, np.ndarray]:
    """Gain and left bins of the best split of one node by one feature; -inf if none is allowed."""
    weigh = lambda g, h: np.maximum(np.abs(g) - p.l1, 0) ** 2 / (h + p.l2 + 1e-300)
    order = np.arange(len(g))
    if categorical:
        ratio = np.where(n > 0, g / np.where(h + p.l2 > 0, h + p.l2, 1), np.inf)  # empty bins last: they go right
        order = np.argsort(ratio, kind="stable")
    gl, hl, nl = (np.cumsum(v[order])[:-1] for v in (g, h, n))
    gr, hr, nr = g.sum() - gl, h.sum() - hl, n.sum() - nl
    gain = weigh(gl, hl) + weigh(gr, hr) - weigh(g.sum(), h.sum())
    gain = np.where((nl >= max(p.min_rows, 1)) & (nr >= max(p.min_rows, 1)) & (hl > 0) & (hr > 0), gain, -np.inf)
    k = int(gain.argmax())
    left = np.zeros(len(g), bool)
    left[order[: k + 1]] = True
    return float(gain[k]), left


def _leaf(g: float, h: float, p: Params) -> float:
    return -math.copysign(max(abs(g) - p.l1, 0.0), g) / (h + p.l2) * p.rate if h + p.l2 > 0 else 0.0


def level_splits(made: DataFrame, boosters: list[Booster], growing: list[Tree], open_nodes: list[list[int]], allowed: list[np.ndarray], refreshed: int, categorical: np.ndarray) -> DataFrame:
    """The best split of each open node of each booster's growing tree: booster, node, feature, gain, left and the sums of both sides."""
    n_features, params = len(categorical), [b.params for b in boosters]

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        part = None
        for frame in frames:
            for row in frame.to_dict("records"):
                b = _open(row, n_features, len(boosters))
                part = b.block if part is None else part
                for m, (booster, tree, nodes) in enumerate(zip(boosters, growing, open_nodes)):
                    if not nodes:
                        continue
                    p = booster.params
                    slot = np.full(len(tree.split), -1, np.int64)
                    slot[nodes] = np.arange(len(nodes))
                    at = slot[tree.nodes(b.bins)]
                    rows = np.flatnonzero((at >= 0) & _taught(p, b, len(booster.trees)))
                    bins, at = b.bins[rows], at[rows] * BINS
                    g, h = gradients(p, b.label[rows], _weights(p, b)[rows], booster.base + b.score[m, rows] + booster.raw(bins, refreshed))
                    mine = total.setdefault(m, np.zeros((len(nodes), n_features, 3, BINS)))
                    for f in np.flatnonzero(allowed[m]):
                        key = at + bins[:, f]
                        for k, v in enumerate((g, h, None)):
                            mine[:, f, k] += np.bincount(key, v, len(nodes) * BINS).reshape(-1, BINS)
        out = [(part, m, node, int(f), t[k, f].tobytes()) for m, t in total.items() for k, node in enumerate(open_nodes[m]) for f in np.flatnonzero(allowed[m])]
        yield pd.DataFrame(out, columns=["part", "booster", "node", "feature", "sums"])

    def choose(key: tuple, rows: list[tuple]) -> tuple:
        m, node, f = key
        g, h, n = sum(np.frombuffer(x, np.float64).reshape(3, BINS) for (x,) in rows)
        gain, left = best_split(g, h, n, params[m], bool(categorical[f]))
        return m, node, f, gain, left.tobytes(), float(g[left].sum()), float(h[left].sum()), float(g.sum()), float(h.sum())

    partial = made.mapInPandas(sums, "part long, booster int, node int, feature int, sums binary")
    each = by_key(partial, ["booster", "node", "feature"], ["sums"], choose, "booster int, node int, feature int, gain double, left binary, gl double, hl double, g double, h double")
    best = F.max_by(F.struct("feature", "gain", "left", "gl", "hl", "g", "h"), F.struct("gain", -F.col("feature")))
    return each.groupBy("booster", "node").agg(best.alias("best")).select("booster", "node", "best.*")


def by_key(partial: DataFrame, keys: list[str], values: list[str], finish: Callable[[tuple, list[tuple]], tuple], schema: str) -> DataFrame:
    """One row for each key of what the tasks sent for it, in the order of their parts; a key has a row a task at most."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, at, held, out = [c.split()[0] for c in schema.split(", ")], None, [], []
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                key, rest = tuple(map(int, row[: len(keys)])), row[len(keys) :]
                if key != at:
                    if held:
                        out.append(finish(at, held))
                    at, held = key, []
                held.append(rest)
        if held:
            out.append(finish(at, held))
        yield pd.DataFrame(out, columns=names)

    dealt = partial.repartition(*keys).sortWithinPartitions(*keys, "part")
    return dealt.select(*keys, *values).mapInPandas(walk, schema)


def summary(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values with weights; where there are more, so many that stand for equal weights each."""
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    if len(values) <= points:
        return values, weights
    cum = np.cumsum(weights)
    at = np.searchsorted(cum, (np.arange(points) + 0.5) / points * cum[-1])
    return values[at], np.full(points, cum[-1] / points)


def weighted_quantile(values: np.ndarray, weights: np.ndarray, alpha: float) -> float:
    """The smallest value up to which lies a share of alpha of the weight."""
    order = np.argsort(values, kind="stable")
    cum = np.cumsum(weights[order])
    return float(values[order][min(np.searchsorted(cum, alpha * cum[-1] * (1 - 1e-12)), len(values) - 1)])


def residual_quantiles(made: DataFrame, boosters: list[Booster], growing: list[Tree], refreshed: int, n_features: int) -> DataFrame:
    """booster, node, quantile of the residuals in each leaf of the growing trees of quantile boosters.

    Tasks send a bounded summary of each leaf; summaries meet in a first round by part of the tasks and then as one for each leaf.
    """
    schema = "part long, booster int, node int, x binary, w binary"
    pack = lambda part, m, node, x, w: (int(part), int(m), int(node), x.tobytes(), w.tobytes())
    names = ["part", "booster", "node", "x", "w"]

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        part = 0
        for frame in frames:
            for row in frame.to_dict("records"):
                b = _open(row, n_features, len(boosters))
                part = part or b.block
                for m, (booster, tree) in enumerate(zip(boosters, growing)):
                    if booster.params.objective != "quantile":
                        continue
                    rows = np.flatnonzero(_taught(booster.params, b, len(booster.trees)))
                    node = tree.nodes(b.bins[rows])
                    rest = b.label[rows] - booster.base - b.score[m, rows] - booster.raw(b.bins[rows], refreshed)
                    for k in np.unique(node):
                        x, w = held.get((m, k), (np.zeros(0), np.zeros(0)))
                        own = node == k
                        held[m, k] = summary(np.concatenate([x, rest[own]]), np.concatenate([w, _weights(booster.params, b)[rows][own]]), 8 * POINTS)
        yield pd.DataFrame([pack(part, m, k, *summary(x, w)) for (m, k), (x, w) in held.items()], columns=names)

    def joined(rows: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.frombuffer(b"".join(r[k + j] for r in rows), np.float64) for j in (0, 1))

    def merge(key: tuple, rows: list[tuple]) -> tuple:
        return pack(min(r[0] for r in rows), *key[:2], *summary(*joined(rows, 1), 8 * POINTS))

    def value(key: tuple, rows: list[tuple]) -> tuple:
        return *key, weighted_quantile(*joined(rows, 0), boosters[key[0]].params.alpha)

    lanes = 1 + made.rdd.getNumPartitions() // 64
    sent = made.mapInPandas(leaves, schema).withColumn("lane", F.pmod(F.xxhash64("part"), F.lit(lanes)))
    met = by_key(sent, ["booster", "node", "lane"], ["part", "x", "w"], merge, schema)
    return by_key(met, ["booster", "node"], ["x", "w"], value, "booster int, node int, quantile double")


def _bases(made: DataFrame, boosters: list[Booster], n_features: int) -> None:
    """Each booster's constant: logarithm of the mean, mean, or quantile of the labels."""

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(boosters), 2))
        for frame in frames:
            for row in frame.to_dict("records"):
                b = _open(row, n_features, len(boosters))
                for m, booster in enumerate(boosters):
                    w = np.where(b.order > booster.params.after, _weights(booster.params, b), 0.0)
                    total[m] += (w * b.label).sum(), w.sum()
        yield pd.DataFrame([(m, *t) for m, t in enumerate(total)], columns=["booster", "y", "w"])

    means = {r["booster"]: r["y"] / r["w"] if r["w"] else 0.0 for r in made.mapInPandas(sums, "booster int, y double, w double").groupBy("booster").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).collect()}
    for m, booster in enumerate(boosters):
        mean = means.get(m, 0.0)
        booster.base = math.log(max(mean, 1e-6)) if booster.params.objective == "tweedie" else mean if booster.params.objective == "l2" else 0.0
    if any(b.params.objective == "quantile" for b in boosters):
        for r in residual_quantiles(made, boosters, [Tree.root(0) for _ in boosters], 0, n_features).collect():
            boosters[r["booster"]].base = r["quantile"]


class Training:
    """Boosters that grow in step over the same blocks."""

    def __init__(self, frame: DataFrame, binning: Binning, params: list[Params], label: str = "label", weight: str = "weight", order: str | None = None) -> None:
        self.binning, self.boosters, self.refreshed = binning, [Booster(p) for p in params], 0
        self.categorical = np.array([c in binning.categories for c in binning.features])
        self.made = cut(blocks(frame, binning, len(params), label, weight, order))
        _bases(self.made, self.boosters, len(self.categorical))

    def grow(self, trees: int, only: set[str] | None = None) -> Training:
        """So many more trees for each booster, or for those with these names."""
        for _ in range(trees):
            if max(len(b.trees) for b in self.boosters) - self.refreshed >= REFRESH:
                self._refresh()
            self._tree([only is None or b.params.name in only for b in self.boosters])
        return self

    def _refresh(self) -> None:
        """Write each row's score so far into its block, so that no pass walks all trees again."""
        boosters, first, n_features = self.boosters, self.refreshed, len(self.categorical)

        def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                scores = []
                for row in frame.to_dict("records"):
                    b = _open(row, n_features, len(boosters))
                    scores.append(np.stack([b.score[m] + booster.raw(b.bins, first) for m, booster in enumerate(boosters)]).tobytes())
                yield frame.assign(score=scores)

        self.made = cut(self.made.mapInPandas(write, _BLOCK))
        self.refreshed = max(len(b.trees) for b in boosters)

    def _tree(self, wanted: list[bool]) -> None:
        names = self.binning.features
        growing = [Tree.root(b.params.depth) for b in self.boosters]
        open_nodes = [[0] if w else [] for w in wanted]
        leaves, allowed = [1] * len(growing), []
        for b in self.boosters:
            rng, mask = np.random.default_rng([b.params.seed, len(b.trees)]), np.array([n not in b.params.without for n in names])
            some = rng.random(len(names)) < b.params.feature_share
            allowed.append(mask & some if (mask & some).any() else mask)
        for level in range(max(b.params.depth for b in self.boosters)):
            open_nodes = [nodes if level < b.params.depth else [] for nodes, b in zip(open_nodes, self.boosters)]
            if not any(open_nodes):
                break
            found = level_splits(self.made, self.boosters, growing, open_nodes, allowed, self.refreshed, self.categorical).collect()
            open_nodes = [[] for _ in growing]
            for r in sorted(found, key=lambda r: (-r["gain"], r["node"])):
                m, k = r["booster"], r["node"]
                p, tree = self.boosters[m].params, growing[m]
                tree.value[k] = _leaf(r["g"], r["h"], p)
                if not (r["gain"] > max(p.min_gain, 1e-12)) or leaves[m] >= p.leaves:
                    continue
                leaves[m] += 1
                tree.split[k], tree.feature[k], tree.gain[k] = True, r["feature"], r["gain"]
                tree.left[k] = np.frombuffer(r["left"], bool)
                tree.value[2 * k + 1], tree.value[2 * k + 2] = _leaf(r["gl"], r["hl"], p), _leaf(r["g"] - r["gl"], r["h"] - r["hl"], p)
                open_nodes[m] += [2 * k + 1, 2 * k + 2]
        if any(w and b.params.objective == "quantile" for w, b in zip(wanted, self.boosters)):
            for r in residual_quantiles(self.made, self.boosters, growing, self.refreshed, len(names)).collect():
                growing[r["booster"]].value[r["node"]] = self.boosters[r["booster"]].params.rate * r["quantile"]
        for w, b, tree in zip(wanted, self.boosters, growing):
            if not w:
                tree = Tree.root(0)  # stands still, so that all boosters have as many trees
            b.trees.append(tree)

    def model(self) -> Model:
        return Model(self.binning, [replace(b, trees=list(b.trees)) for b in self.boosters])


@dataclass
class Model:
    binning: Binning
    boosters: list[Booster]

    def transform(self, frame: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
        """frame with a column of predictions for each booster, named as it or as columns says; one batch of Arrow at a time."""
        named = columns or {b.params.name: b.params.name for b in self.boosters}
        chosen = [b for b in self.boosters if b.params.name in named]
        sent = frame.sparkSession.sparkContext.broadcast((self.binning, chosen))  # trees and edges: small by depth and BINS

        @F.pandas_udf("array<double>")
        def score(x: pd.DataFrame) -> pd.Series:
            binning, boosters = sent.value
            bins = binning.matrix(x)
            return pd.Series(list(np.stack([b.predict(bins) for b in boosters], axis=1)), dtype=object)

        out = frame.withColumn("__raw", score(F.struct(*self.binning.columns())))
        return out.withColumns({named[b.params.name]: F.col("__raw")[k] for k, b in enumerate(chosen)}).drop("__raw")

    def gains(self, name: str) -> dict[str, float]:
        """Share of the booster's total gain, in per cent, by feature."""
        booster = next(b for b in self.boosters if b.params.name == name)
        total = np.zeros(len(self.binning.features))
        for tree in booster.trees:
            np.add.at(total, tree.feature[tree.split], tree.gain[tree.split])
        return dict(zip(self.binning.features, (100 * total / max(total.sum(), 1e-300)).tolist()))
