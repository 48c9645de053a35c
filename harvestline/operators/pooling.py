"""Partial pooling of groups' demand shapes: empirical Bayes on each group's Gram matrix.

A group's log ratio of units to its series' levels is a base, a trend and a season of Fourier terms. Base and trend of the groups scatter
around common means, season terms around 0; the scatter is estimated from all groups, so groups with little or noisy history lean
on the others. Spark sums the products of terms by group (one row a group, whatever the number of weeks and series); the estimate works
on those few numbers alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.functions import week_number

#: Season's harmonics, damping of the trend beyond the history, and growth of the base's share over the horizon; fixed values.
HARMONICS, TREND_DAMP, BASE_RAMP = 5, 0.6, 0.85
#: Blocks of terms that share one scatter: base, trend, season.
_BLOCKS = (slice(0, 1), slice(1, 2), slice(2, None))


def terms(week: Column, end: Column, harmonics: int = HARMONICS) -> list[Column]:
    """1, years since the end of the history, and sines and cosines of the week of the year."""
    angle = 2 * math.pi * F.weekofyear(week) / 52.0
    season = [f(k * angle) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), (week_number(week) - week_number(end)) / 52.0, *season]


def gram(ratios: DataFrame, key: str, end: DataFrame, harmonics: int = HARMONICS) -> DataFrame:
    """One row for each group of ratios (key, week, ratio > 0): n, sum of y squared, the products of terms with y and with each other; y is the log ratio."""
    names = [f"x{k}" for k in range(2 + 2 * harmonics)]
    at = ratios.crossJoin(F.broadcast(end))  # one row: end
    rows = at.select(key, F.ln("ratio").alias("y"), *(c.alias(n) for c, n in zip(terms(F.col("week_start_date"), F.col("end"), harmonics), names)))
    products = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), *(F.sum(F.col(a) * F.col("y")).alias(f"{a}_y") for a in names), *products)


@dataclass
class Pooled:
    """Groups' coefficients with their covariances, the common means, the scatter of each block and the noise."""

    keys: list[str]
    mean: np.ndarray
    cov: np.ndarray
    common: np.ndarray
    scatter: np.ndarray
    noise: float


def fit(grams: DataFrame, key: str, rounds: int = 500, tolerance: float = 1e-9) -> Pooled:
    """Expectation maximisation; grams is small: a row for each group, and groups are few (departments, stores)."""
    found = grams.orderBy(key).collect()
    size = sum(c.endswith("_y") for c in grams.columns)
    xx, xy = np.zeros((len(found), size, size)), np.array([[r[f"x{k}_y"] for k in range(size)] for r in found]).reshape(-1, size)
    for g, r in enumerate(found):
        for i in range(size):
            for j in range(i, size):
                xx[g, i, j] = xx[g, j, i] = r[f"x{i}_x{j}"]
    n, yy = np.array([r["n"] for r in found], float), np.array([r["yy"] for r in found], float)
    return Pooled([r[key] for r in found], *estimate(n, yy, xy, xx, rounds, tolerance))


def estimate(n: np.ndarray, yy: np.ndarray, xy: np.ndarray, xx: np.ndarray, rounds: int = 500, tolerance: float = 1e-9) -> tuple:
    """Means, covariances, common means, scatter and noise from the groups' sums."""
    groups, size = xy.shape
    common, scatter, noise = np.zeros(size), np.full(size, 0.1), max(float(yy.sum() / max(n.sum(), 1)), 1e-6)
    mean, cov = np.zeros((groups, size)), np.zeros((groups, size, size))
    for _ in range(rounds if groups else 0):
        before = np.concatenate([common, scatter, [noise]])
        cov = np.linalg.inv(xx / noise + np.diag(1 / scatter))
        mean = np.einsum("gij,gj->gi", cov, xy / noise + common / scatter)
        common = np.concatenate([mean[:, :2].mean(axis=0), np.zeros(size - 2)])
        spread = (mean - common) ** 2 + np.einsum("gii->gi", cov)
        for block in _BLOCKS:
            scatter[block] = max(spread[:, block].mean(), 1e-8)
        fitted = np.einsum("gi,gij,gj->g", mean, xx, mean) + np.einsum("gij,gji->g", xx, cov)
        noise = max(float((yy - 2 * (mean * xy).sum(axis=1) + fitted).sum() / n.sum()), 1e-6)
        if np.abs(np.concatenate([common, scatter, [noise]]) - before).max() < tolerance:
            break
    return mean, cov, common, scatter, noise


def forecast(pooled: Pooled, rows: DataFrame, level: DataFrame, key: str, end: DataFrame, horizon: int = 8, width: float = 1.2816) -> DataFrame:
    """id, week, p10, pred, p90 of rows (id, key, week): level times the group's shape, its interval from the coefficients' covariance.

    The base grows to its full share at the horizon and the trend is damped, since both are extrapolated. Series without a level have
    0, groups that weren't fitted the common shape.
    """
    size = len(pooled.common)
    spark, harmonics = rows.sparkSession, (size - 2) // 2
    upper = [np.linalg.cholesky(c + 1e-12 * np.eye(size)).ravel().tolist() for c in pooled.cov]
    shapes = spark.createDataFrame([(k, m.tolist(), u) for k, m, u in zip(pooled.keys, pooled.mean, upper)], f"{key} string, beta array<double>, root array<double>")
    joined = rows.select("id", key, "week_start_date").crossJoin(F.broadcast(end)).join(F.broadcast(shapes), key, "left").join(level, "id", "left")  # a row for each group
    h = week_number(F.col("week_start_date")) - week_number(F.col("end"))
    ramp = (1 - F.pow(F.lit(BASE_RAMP), h)) / (1 - BASE_RAMP**horizon)
    x = F.array(*(c * k for c, k in zip(terms(F.col("week_start_date"), F.col("end"), harmonics), [ramp, F.lit(TREND_DAMP), *[F.lit(1.0)] * (2 * harmonics)])))
    out = joined.withColumn("x", x).withColumn("beta", F.coalesce("beta", F.array(*(F.lit(float(v)) for v in pooled.common))))
    dot = F.aggregate(F.zip_with("x", "beta", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    # The variance of x * beta is the squared length of x times the root of the covariance.
    column = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda a, i: a + F.element_at("x", i + 1) * F.element_at("root", i * size + j + 1))
    variance = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), column), F.lit(0.0), lambda a, v: a + v * v)
    out = out.withColumns({"shape": dot, "sd": F.coalesce(F.sqrt(variance + pooled.noise), F.lit(math.sqrt(pooled.noise)))})
    value = lambda k: F.coalesce("level", F.lit(0.0)) * F.exp(F.col("shape") + k * F.col("sd"))
    return out.select("id", "week_start_date", value(-width).alias("p10"), value(0.0).alias("pred"), value(width).alias("p90"))
