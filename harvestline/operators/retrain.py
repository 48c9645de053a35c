"""From data to a serving model: validate, train, backtest, gate, promote; and a model that serving takes up without a restart."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.operators.boosting import BINS, Binning, Booster, Model, Params, Tree
from harvestline.sources.store import Store

POINTER = "name string, path string, wrmsse double, features array<string>, trained_at timestamp"


def _tree(tree: Tree) -> dict:
    return {"split": tree.split.tolist(), "feature": tree.feature.tolist(), "left": [np.flatnonzero(v).tolist() for v in tree.left], "value": tree.value.tolist(), "gain": tree.gain.tolist()}


def _grown(t: dict) -> Tree:
    left = np.zeros((len(t["left"]), BINS), bool)
    for k, bins in enumerate(t["left"]):
        left[k, bins] = True
    return Tree(np.array(t["split"]), np.array(t["feature"], np.int64), left, np.array(t["value"]), np.array(t["gain"]))


def save_boosters(spark: SparkSession, model: Model, path: str) -> None:
    """One row for the binning and one for each booster; a model is small whatever it was trained on."""
    rows = [("binning", json.dumps({"numeric": model.binning.numeric, "categories": model.binning.categories}))]
    rows += [(b.params.name, json.dumps({"params": asdict(b.params), "base": b.base, "trees": [_tree(t) for t in b.trees]})) for b in model.boosters]
    spark.createDataFrame([(k, n, body) for k, (n, body) in enumerate(rows)], "k int, name string, body string").coalesce(1).write.parquet(path)


def load_boosters(spark: SparkSession, path: str) -> Model:
    rows = [json.loads(r["body"]) for r in spark.read.parquet(path).orderBy("k").collect()]
    boosters = [Booster(Params(**b["params"] | {"without": tuple(b["params"]["without"])}), b["base"], [_grown(t) for t in b["trees"]]) for b in rows[1:]]
    return Model(Binning(**rows[0]), boosters)


class Artifacts:
    """Saved models of a folder and the pointer to the one that serves."""

    def __init__(self, spark: SparkSession, folder: str, features: list[str]) -> None:
        self.spark, self.folder, self.features = spark, folder, features
        self.pointer = Store(spark, f"{folder}/pointer", POINTER, ["name"])
        self._held: tuple[str, Model] | None = None

    def promote(self, model: Model, wrmsse: float) -> str:
        """Save the model, then turn the pointer to it; a save that fails leaves the pointer."""
        path = f"{self.folder}/models/{uuid.uuid4().hex}"
        save_boosters(self.spark, model, path)
        row = self.spark.createDataFrame([("serving", path, wrmsse, model.binning.features)], "name string, path string, wrmsse double, features array<string>")
        self.pointer.replace(row.withColumn("trained_at", F.current_timestamp()))
        return path

    def about(self) -> DataFrame:
        """The serving model's row and its age in days; no row without a model."""
        return self.pointer.read().withColumn("artifact_age", (F.unix_micros(F.current_timestamp()) - F.unix_micros("trained_at")) / 86_400e6)

    def model(self) -> Model:
        """The model that the pointer names now, read again only when the pointer has moved; one with other features is refused."""
        row = self.pointer.read().first()
        if row is None:
            raise LookupError(f"no model serves in {self.folder}")
        if self._held is None or self._held[0] != row["path"]:
            if list(row["features"]) != self.features:
                raise ValueError(f"the model reads {row['features']}, not {self.features}")
            self._held = row["path"], load_boosters(self.spark, row["path"])
        return self._held[1]


def retrain(artifacts: Artifacts, violations: DataFrame, train: Callable[[], Model], backtest: Callable[[Model], float], limit: float) -> list[tuple[str, bool, str]]:
    """step, ok, detail of each step that ran; the first that fails ends the run and leaves the serving model.

    violations is one row of counts (n_rows, and one column for each rule), as the contracts give it.
    """
    counts = violations.first().asDict()
    broken = [f"{rule}: {n}" for rule, n in counts.items() if rule != "n_rows" and n]
    log = [("validate", bool(counts["n_rows"]) and not broken, ", ".join(broken) or f"{counts['n_rows']} rows")]
    if not log[-1][1]:
        return log
    model = train()
    log.append(("train", True, f"{sum(len(b.trees) for b in model.boosters)} trees"))
    score = backtest(model)
    log.append(("backtest", True, f"{score:.4f}"))
    log.append(("gate", score <= limit, f"{score:.4f} of {limit}"))
    if log[-1][1]:
        artifacts.promote(model, score)
        log.append(("promote", True, f"{score:.4f}"))
    return log
