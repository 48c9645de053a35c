"""Saved models, importance and forecasts of future rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from harvestline.operators import baselines as B
from harvestline.operators import features as X
from harvestline.operators import models as ML

MONDAY = dt.date(2015, 1, 5)
SCHEMA = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, week_start_date date, units long, revenue double, sell_price double, snap_days int, event_days int, available_days int, n_days int"


@pytest.fixture(scope="module")
def panel(spark):
    data = [(s, s, "x" if s < "c" else "y", "c", "s1", "A" if s < "b" else "B", MONDAY + dt.timedelta(weeks=k), m + k % 3, 2.0 * m, 2.0, k % 4, k % 2, 7, 7) for k in range(40) for s, m in {"a": 3, "b": 5, "c": 9}.items()]
    return spark.createDataFrame(data, SCHEMA).cache()


@pytest.fixture(scope="module")
def frame(panel):
    return ML.prepare(X.build_direct(panel, 2)).filter("lag_1 is not null").cache()


@pytest.fixture(scope="module")
def model(frame):
    return ML.fit_tweedie(frame)


def test_a_saved_model_forecasts_alike_and_refuses_other_features(model, frame, tmp_path):
    ML.save(model, str(tmp_path), dt.datetime(2015, 1, 1))
    rows = lambda m: sorted(map(str, ML.predict(m, frame).collect()))
    assert rows(ML.load(str(tmp_path))) == rows(model)
    assert ML.artifact_age(str(tmp_path), dt.datetime(2015, 1, 16)).first()["artifact_age"] == 15.0
    with pytest.raises(ValueError, match="reads"):
        ML.load(str(tmp_path), ["h"])


def test_importance_equals_numpy(model, frame):
    x = np.array([r["features"].toArray() for r in model.transform(frame).select("features").collect()])
    beta, n = model.stages[-1].coefficients.toArray(), len(ML.NUMERIC)
    x = np.column_stack([x[:, :n] * beta[:n], x[:, n:] @ beta[n:]])  # the department's columns are one feature
    want = np.abs(x - x.mean(axis=0)).mean(axis=0)
    got = {r["feature"]: (r["shap"], r["percent"]) for r in ML.importance(model, frame, 99).collect()}
    for name, value in zip([*ML.NUMERIC, "dept"], want):
        assert got[name][0] == pytest.approx(value) and got[name][1] == pytest.approx(100 * value / want.sum())
    assert ML.importance(model, frame).count() == 15


def test_future_rows_equal_the_rows_that_come(spark, panel, model):
    """A forecast of rows known by the calendar only is that of the rows that came, for they differ in nothing that it reads."""
    origin = F.lit(MONDAY + dt.timedelta(weeks=37))
    weeks = panel.groupBy("week_start_date").agg(F.max("event_days").alias("event_days"), F.max("snap_days").alias("one"), F.max("snap_days").alias("two"))
    train = panel.filter(F.col("week_start_date") <= origin)
    future = B.with_calendar(B.future_rows(train, 2), weeks, {"A": "one"}, "two")
    made = ML.predict(model, ML.prepare(X.future_frame(train, future, 2))).drop("units")
    came = ML.predict(model, ML.prepare(X.select_test(X.build_direct(panel, 2), origin))).drop("units")
    assert made.count() == 6 and sorted(map(str, made.collect())) == sorted(map(str, came.collect()))


def test_future_rows_of_a_late_series_and_a_missing_week(spark, panel):
    last = MONDAY + dt.timedelta(weeks=39)
    holes = panel.filter((F.col("id") != "a") | (F.col("week_start_date") < F.lit(last)))
    weeks = spark.createDataFrame([(last + dt.timedelta(weeks=1), 3, 5, 6)], "week_start_date date, event_days int, one int, two int")
    got = {(r["id"], r["h"]): (r["week_start_date"], r["snap_days"], r["event_days"]) for r in B.with_calendar(B.future_rows(holes, 2), weeks, {"A": "one"}, "two").collect()}
    assert got["a", 1] == (last + dt.timedelta(weeks=1), 5, 3) and got["b", 1][1] == 6 and got["a", 2] == (last + dt.timedelta(weeks=2), 0, 0)


def test_departments_are_told_apart_without_an_order(spark, model, frame):
    sizes = {r["dept_id"]: r["features"].size for r in model.transform(frame).select("dept_id", "features").collect()}
    assert set(sizes.values()) == {len(ML.NUMERIC) + 2} and len(sizes) == 2
    unseen = model.transform(frame.limit(1).withColumn("dept_id", F.lit("new"))).first()
    assert unseen["raw"] > 0 and unseen["features"].toArray()[len(ML.NUMERIC):].tolist() == [0.0, 0.0]
