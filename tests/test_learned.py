"""What is made of boosters: forecasts in order, parts that sum up, errors of what isn't there, breakdowns and small operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestline.operators import baselines as B
from harvestline.operators import eda as E
from harvestline.operators import models as ML
from harvestline.operators import monitoring as O
from harvestline.operators import runs as R
from harvestline.operators.boosting import Params, Training, fit_binning

MONDAY = dt.date(2015, 1, 5)
SCHEMA = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, week_start_date date, units long, revenue double, sell_price double, snap_days int, event_days int, available_days int, n_days int"


@pytest.fixture(scope="module")
def panel(spark):
    """Series that sell more on promotion (every sixth week at 70 % of the price) and in event weeks."""
    rows = []
    for s, m in {"a": 10, "b": 20, "c": 40}.items():
        for k in range(70):
            promo, event = k % 6 == 5, k % 5 == 2
            price = 1.4 if promo else 2.0
            units = int(m * (2 if promo else 1) * (1.5 if event else 1)) + k % 3
            rows.append((s, s, "x" if s < "c" else "y", "c", "s1", "A", MONDAY + dt.timedelta(weeks=k), units, units * price, price, 2, 3 if event else 0, 0 if (s, k) == ("b", 69) else 7, 7))
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def trained(panel):
    frame = ML.boost_frame(panel).filter("lag_1 is not null and h <= 2").cache()
    params = [Params("point", depth=3, min_rows=10, rate=0.4), Params("q10", "quantile", alpha=0.1, depth=2, min_rows=10, rate=0.4), Params("q90", "quantile", alpha=0.9, depth=2, min_rows=10, rate=0.4)]
    return frame, Training(frame, fit_binning(frame, ML.BOOST_NUMERIC, ML.BOOST_CATEGORIES), params).grow(8).model()


def test_quantiles_are_in_order_and_nothing_sells_where_nothing_is_available(trained):
    frame, model = trained
    rows = ML.boosted_quantiles(model, frame, "q90", "q10").collect()  # in order whatever their names say
    assert len(rows) == frame.count() and all(0 <= r["q90"] <= r["q10"] for r in rows)
    gone = [r for r in rows if r["series_id"] == "b" and r["week_start_date"] == MONDAY + dt.timedelta(weeks=69)]
    assert gone and all(r["q10"] == 0 for r in gone)
    masked = ML.masked(model.transform(frame, {"point": "raw"})).filter("id = 'b' and week_start_date = '2016-05-02'").collect()
    assert {r["pred"] for r in masked} == {0.0}


def test_parts_sum_to_the_forecast_and_name_what_moves_it(trained):
    frame, model = trained
    forecast = lambda rows: model.transform(rows, {"point": "raw"})
    late = frame.filter(F.col("week_start_date") > F.lit(MONDAY + dt.timedelta(weeks=20)))
    whole = {(r["id"], r["week_start_date"], r["h"]): r["raw"] for r in forecast(late).collect()}
    rows = ML.decompose(forecast, late, ML.BOOST_NEUTRAL).collect()
    assert len(rows) == len(whole)
    for r in rows:
        assert r["total"] == pytest.approx(whole[r["id"], r["week_start_date"], r["h"]])
        assert r["base"] + r["promo"] + r["seasonality"] + r["events"] == pytest.approx(r["total"])
    week = lambda r: (r["week_start_date"] - MONDAY).days // 7
    mean = lambda xs: sum(xs) / len(xs)
    assert mean([r["promo"] for r in rows if week(r) % 6 == 5]) > 5 * max(mean([abs(r["promo"]) for r in rows if week(r) % 6 == 1]), 0.1)
    assert mean([r["events"] for r in rows if week(r) % 5 == 2]) > 1


def test_one_series_in_order_or_an_error(trained):
    frame, model = trained
    forecast = lambda rows: model.transform(rows, {"point": "raw"})
    rows = ML.decompose_series(forecast, frame.filter("h = 1"), "a", "s1", ML.BOOST_NEUTRAL).collect()
    weeks = [r["week_start_date"] for r in rows]
    assert weeks == sorted(weeks) and {r["id"] for r in rows} == {"a"}
    with pytest.raises(ValueError, match="no series"):
        ML.decompose_series(forecast, frame, "a", "elsewhere")


def test_imapa_by_hand(spark):
    """Sales in every second week of eight: levels 1 and 2; the sums of level 2 are all 6, so both levels are known."""
    weeks = [MONDAY + dt.timedelta(weeks=k) for k in range(8)]
    rows = [("s", w, 6 * (k % 2)) for k, w in enumerate(weeks)] + [("never", w, 0) for w in weeks] + [("always", w, 5) for w in weeks]
    got = {r["id"]: (r["rate"], r["levels"]) for r in B.imapa(spark.createDataFrame(rows, "id string, week_start_date date, units long")).collect()}

    def smooth(y, alpha):
        level, error = y[0], 0.0
        for v in y[1:]:
            error, level = error + (v - level) ** 2, alpha * v + (1 - alpha) * level
        return error, level

    first = min(smooth([6.0 * (k % 2) for k in range(8)], a) for a in (0.1, 0.15, 0.2, 0.25, 0.3))[1]
    assert got["s"] == (pytest.approx((first + 3.0) / 2), 2) and got["never"] == (0.0, 0) and got["always"] == (5.0, 1)


def test_breakdowns_of_a_run_and_rows_without_a_key(spark):
    rows = [(1, "A", True, "frequent", 1.0, 2.0, 3.0, 2), (1, "B", False, None, 1.0, 4.0, 5.0, 2), (2, "B", False, None, 0.0, 0.0, 0.0, 0)]
    matched = spark.createDataFrame(rows, "h int, state_id string, promo boolean, segment string, p10 double, p50 double, p90 double, units int")
    got = {(r["by"], r["key"]): (r["n"], r["wmape"], r["bias"], r["coverage"]) for r in O.breakdowns(matched).collect()}
    assert got == {
        ("h", "1"): (2, 0.5, 0.5, 1.0), ("state_id", "A"): (1, 0.0, 0.0, 1.0), ("state_id", "B"): (2, 1.0, 1.0, 1.0), ("promo", "true"): (1, 0.0, 0.0, 1.0),
        ("promo", "false"): (2, 1.0, 1.0, 1.0), ("segment", "frequent"): (1, 0.0, 0.0, 1.0),
    }
    assert O.labelled(O.breakdowns(matched)).filter("name = 'forecast_wmape'").count() == 6


def test_an_empty_slice_makes_no_run(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert R.create_run(ids, 3, 2).count() == 2
    with pytest.raises(ValueError, match="no series"):
        R.create_run(ids.limit(0), 3)


def test_lorenz_of_few(spark):
    p = spark.createDataFrame([("a", 6), ("b", 3), ("c", 1), ("d", 0)], "id string, units long")
    assert [tuple(r) for r in E.lorenz(p, points=4).orderBy("step").collect()] == [(1, 1, 0.6), (2, 2, 0.9), (3, 3, 1.0), (4, 4, 1.0)]
