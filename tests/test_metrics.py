"""Hand-made panels for the metrics, and properties that must hold whatever the numbers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestline.operators import metrics as M

KEYS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
MONDAY = dt.date(2015, 1, 5)


def rows(spark, series, start=0, price=1.0):
    data = [(s, s, "d", "c", "st", "ca", MONDAY + dt.timedelta(weeks=start + k), int(v), float(v * price)) for s, values in series.items() for k, v in enumerate(values)]
    return spark.createDataFrame(data, ", ".join(f"{k} string" for k in KEYS) + ", week_start_date date, units long, revenue double")


def predictions(spark, series, start):
    return spark.createDataFrame([(s, MONDAY + dt.timedelta(weeks=start + k), float(v)) for s, vs in series.items() for k, v in enumerate(vs)], "id string, week_start_date date, pred double")


def one(df):
    return df.first().asDict()


def test_hand_computed_half(spark):
    got = one(M.all_metrics(rows(spark, {"a": [10, 12] * 3}), rows(spark, {"a": [10, 12]}, 6), predictions(spark, {"a": [11, 11]}, 6)))
    assert {k: round(v, 9) for k, v in got.items()} == {"wrmsse12": 0.5, "wrmsse9": 0.5, "rmsse_l12": 0.5, "mase_l12": 0.5, "bias": 0.0}


def test_perfect_forecast(spark):
    got = one(M.all_metrics(rows(spark, {"a": [5, 7, 5, 7]}), rows(spark, {"a": [5, 7]}, 4), predictions(spark, {"a": [5, 7]}, 4)))
    assert set(got.values()) == {0.0}


@pytest.mark.parametrize("factor,expected", [(2.0, 1.0), (0.0, -1.0)])
def test_bias_has_a_sign(spark, factor, expected):
    assert one(M.bias(rows(spark, {"a": [5, 7]}), predictions(spark, {"a": [5 * factor, 7 * factor]}, 0)))["bias"] == expected


def test_constant_series_has_no_score(spark):
    assert one(M.wrmsse(M.rmsse(rows(spark, {"a": [3] * 4}), rows(spark, {"a": [3]}, 4), predictions(spark, {"a": [3]}, 4))))["wrmsse"] is None


def test_naive_scale(spark):
    assert {r["scale"] for r in M.naive_scale(M.level_agg(rows(spark, {"a": [10, 12] * 3}))).collect()} == {4.0}


def test_weights_sum_to_one_in_each_level(spark):
    p = rows(spark, {"a": [4, 4, 4, 4]}, price=5.0).union(rows(spark, {"b": [4, 4, 4, 4]}))
    w = M.level_weights(M.level_agg(p))
    assert all(abs(r["s"] - 1) < 1e-12 for r in w.groupBy("level").agg(F.sum("weight").alias("s")).collect())
    by = {r["sid"]: r["weight"] for r in w.filter("level = 12").collect()}
    assert by["a"] > by["b"]


def test_a_key_twice_fails(spark):
    twice = predictions(spark, {"a": [1, 1]}, 0).union(predictions(spark, {"a": [1]}, 0))
    with pytest.raises(Exception, match="twice"):
        M.one_to_one(rows(spark, {"a": [1, 1]}), twice).collect()
