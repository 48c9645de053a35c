"""Partial pooling against least squares and a plain mixed model in numpy, and what the forecast is made of."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestline.operators import pooling as P

MONDAY = dt.date(2015, 1, 5)


def week(k):
    return MONDAY + dt.timedelta(weeks=k)


@pytest.fixture(scope="module")
def rows():
    """Groups of different bases and trends over the same season; the last has four weeks only."""
    rng = np.random.default_rng(4)
    out = []
    for g, (base, trend, n) in enumerate([(0.1, 0.2, 150), (-0.1, 0.1, 150), (0.3, 0.15, 150), (0.0, 0.12, 150), (0.9, 0.0, 4)]):
        for k in range(150 - n, 150):
            angle = 2 * math.pi * week(k).isocalendar().week / 52
            out.append((f"g{g}", week(k), math.exp(base + trend * (k - 149) / 52 + 0.3 * math.sin(angle) + 0.1 * rng.standard_normal())))
    return out


@pytest.fixture(scope="module")
def grams(spark, rows):
    end = spark.createDataFrame([(week(149),)], "end date")
    return P.gram(spark.createDataFrame(rows, "dept_id string, week_start_date date, ratio double").repartition(3), "dept_id", end, 2)


def design(rows, group):
    own = [(w, r) for g, w, r in rows if g == group]
    x = np.array([[1.0, (w - week(149)).days / 7 / 52] + [f(k * 2 * math.pi * w.isocalendar().week / 52) for k in (1, 2) for f in (math.sin, math.cos)] for w, _ in own])
    return x, np.log([r for _, r in own])


def test_gram_matrices_equal_numpy(rows, grams):
    for r in grams.collect():
        x, y = design(rows, r["dept_id"])
        assert r["n"] == len(y) and r["yy"] == pytest.approx(y @ y)
        for i in range(6):
            assert r[f"x{i}_y"] == pytest.approx(x[:, i] @ y, abs=1e-9)
            assert all(r[f"x{i}_x{j}"] == pytest.approx(x[:, i] @ x[:, j], abs=1e-9) for j in range(i, 6))


def test_estimate_equals_a_plain_mixed_model(rows, grams):
    """Expectation maximisation on the rows themselves, group by group with matrices of all weeks, ends at the same place."""
    got = P.fit(grams, "dept_id")
    data = [design(rows, g) for g in got.keys]
    common, scatter, noise = np.zeros(6), np.full(6, 0.1), sum(y @ y for _, y in data) / sum(len(y) for _, y in data)
    for _ in range(500):
        mean, cov = [], []
        for x, y in data:  # the posterior of a group by the covariance of its observations
            v = x @ np.diag(scatter) @ x.T + noise * np.eye(len(y))
            gain = np.diag(scatter) @ x.T @ np.linalg.inv(v)
            mean.append(common + gain @ (y - x @ common))
            cov.append(np.diag(scatter) - gain @ x @ np.diag(scatter))
        common = np.concatenate([np.mean(mean, axis=0)[:2], np.zeros(4)])
        spread = [(m - common) ** 2 + np.diag(c) for m, c in zip(mean, cov)]
        scatter = np.concatenate([np.mean(spread, axis=0)[:2], np.full(4, np.mean([s[2:] for s in spread]))])
        noise = sum(((y - x @ m) ** 2).sum() + np.trace(x @ c @ x.T) for (x, y), m, c in zip(data, mean, cov)) / sum(len(y) for _, y in data)
    assert np.allclose(got.mean, mean, atol=1e-5) and np.allclose(got.common, common, atol=1e-5)
    assert got.noise == pytest.approx(noise, rel=1e-4) and np.allclose(got.cov, cov, atol=1e-6)


def test_a_short_group_leans_on_the_others(rows, grams):
    got = P.fit(grams, "dept_id")
    x, y = design(rows, "g4")
    alone = np.linalg.lstsq(x, y, rcond=None)[0]
    season = np.mean(got.mean[:4, 2])
    assert abs(got.mean[4, 2] - season) < abs(alone[2] - season) and abs(got.mean[4, 1] - got.common[1]) < 0.2
    assert got.cov[4, 0, 0] > 5 * got.cov[0, 0, 0]


def test_forecast_by_hand(spark, grams):
    got = P.fit(grams, "dept_id")
    end = spark.createDataFrame([(week(149),)], "end date")
    rows = spark.createDataFrame([("a", "g0", week(151)), ("b", "none", week(150)), ("c", "g4", week(150))], "id string, dept_id string, week_start_date date")
    level = spark.createDataFrame([("a", 10.0), ("b", 4.0)], "id string, level double")
    out = {r["id"]: r for r in P.forecast(got, rows, level, "dept_id", end).collect()}

    def shape(beta, k):
        angle = 2 * math.pi * week(149 + k).isocalendar().week / 52
        x = np.array([(1 - 0.85**k) / (1 - 0.85**8), 0.6 * k / 52] + [f(j * angle) for j in (1, 2) for f in (math.sin, math.cos)])
        return x @ beta, x

    value, x = shape(got.mean[0], 2)
    sd = math.sqrt(x @ got.cov[0] @ x + got.noise)
    assert out["a"]["pred"] == pytest.approx(10 * math.exp(value)) and out["a"]["p90"] == pytest.approx(10 * math.exp(value + 1.2816 * sd), rel=1e-6)
    assert out["b"]["pred"] == pytest.approx(4 * math.exp(shape(got.common, 1)[0])) and out["c"]["pred"] == 0.0
    assert all(r["p10"] <= r["pred"] <= r["p90"] for r in out.values())


def test_no_groups(spark, grams):
    got = P.fit(grams.limit(0), "dept_id")
    assert got.keys == [] and got.common.shape == (6,)
