"""Leakage, monitoring, runs and contracts on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harvestline.operators import baselines as B
from harvestline.operators import contracts as C
from harvestline.operators import features as X
from harvestline.operators import monitoring as O
from harvestline.operators import runs as R

MONDAY = dt.date(2015, 1, 5)
SCHEMA = "id string, item_id string, dept_id string, cat_id string, store_id string, state_id string, week_start_date date, units long, revenue double, sell_price double, snap_days int, event_days int, available_days int, n_days int"


@pytest.fixture(scope="module")
def panel(spark):
    """Four series of 50 weeks in two stores; one sells once in five weeks."""
    mean = {"a": 5, "b": 0, "c": 4, "d": 6}
    data = []
    for k in range(50):
        for s, m in mean.items():
            units = m if m else int(k % 5 == 0)
            data.append((s, s, "x", "c", "s1" if s in "ab" else "s2", "CA" if s in "ab" else "TX", MONDAY + dt.timedelta(weeks=k), units, 2.0 * units, 2.0, 1, int(k % 4 == 0), 7, 7))
    return spark.createDataFrame(data, SCHEMA).cache()


@pytest.fixture(scope="module")
def points(spark, panel):
    """Two runs that were right."""
    out = None
    for run, at in ((1, 38), (2, 40)):
        origin = MONDAY + dt.timedelta(weeks=at - 1)
        h = (F.date_diff("week_start_date", F.lit(origin)) / 7).cast("int")
        one = panel.withColumns({"h": h, "p50": F.col("units").cast("double")}).filter("h between 1 and 8").select(
            F.lit(run).cast("long").alias("run_id"), F.col("id").alias("series_id"), "week_start_date", "h", (0.5 * F.col("p50")).alias("p10"), "p50", (1.5 * F.col("p50") + 1).alias("p90"), F.lit(origin).alias("origin"))
        out = one if out is None else out.union(one)
    return out


def test_future_units_do_not_leak(panel):
    origin = MONDAY + dt.timedelta(weeks=40)
    dirty = panel.withColumn("units", F.when(F.col("week_start_date") > F.lit(origin), 99999).otherwise(F.col("units")))
    columns = ["id", "week_start_date", "h", *(f"lag_{k}" for k in X.LAGS), "rmean_4", "rstd_13", "rmax_13", "nz_share_4", "item_rmean_4", "dept_rmean_4"]
    for pick in (lambda f: f.filter(F.col("week_start_date") <= F.lit(origin)), lambda f: X.select_test(f, F.lit(origin))):
        clean, other = (sorted(map(str, pick(X.build_direct(p)).select(*columns).collect())) for p in (panel, dirty))
        assert clean == other and clean


def test_build_direct_equals_plain_windows(panel):
    frame = X.build_direct(panel)
    for h in (1, 3, 8):
        want = X.rolling(X.lags(panel, h), h).select("id", "week_start_date", "lag_1", "lag_13", "rmean_8", "rstd_13", "rmax_13")
        got = frame.filter(F.col("h") == h).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_accuracy_and_breakdowns(panel, points):
    matched = O.with_actuals(points.filter("run_id = 2"), panel)
    got = O.accuracy(matched).first()
    assert (got["n"], got["wmape"], got["bias"], got["coverage"]) == (32, 0.0, 0.0, 1.0)
    assert {r["state_id"] for r in O.accuracy_by(matched, "state_id").collect()} == {"CA", "TX"}
    assert O.accuracy(matched.filter("run_id = 9")).collect() == []


def test_segments_prefer_coldstart(spark, panel):
    late = spark.createDataFrame([(MONDAY + dt.timedelta(weeks=40),)], "origin date")
    assert {r["series_id"]: r["segment"] for r in O.segments(panel, late).collect()} == {"a": "frequent", "b": "intermittent", "c": "frequent", "d": "frequent"}
    early = spark.createDataFrame([(MONDAY + dt.timedelta(weeks=10),)], "origin date")
    assert {r["segment"] for r in O.segments(panel, early).collect()} == {"coldstart"}


def test_drift_of_equal_and_shifted_windows(spark):
    same = spark.createDataFrame([(s, float(k % 20)) for s in ("reference", "current") for k in range(200)], "side string, x double")
    assert O.psi(same, "x").first()["psi"] == 0.0 and O.ks(same, "x").first()["ks"] == 0.0
    moved = spark.createDataFrame([("reference", float(k)) for k in range(100)] + [("current", float(k + 50)) for k in range(100)], "side string, x double")
    assert O.psi(moved, "x").first()["status"] == "wide" and O.ks(moved, "x").first()["ks"] == 0.5
    flat = spark.createDataFrame([("reference", 1.0), ("current", 2.0)], "side string, x double")
    assert O.psi(flat, "x").first()["status"] == "no_data"


GOOD = {"wmape": 0.3, "bias": 0.05, "coverage": 0.8, "psi": 0.1, "ks": 0.1, "planning_bias": 0.1, "promo_wmape": 0.3, "fva": 5.0, "completeness": 1.0, "revision": 0.1, "run_coverage": 1.0, "artifact_age": 1.0}


@pytest.mark.parametrize("change,warning", [
    ({}, []), ({"wmape": 0.6}, ["wmape"]), ({"wmape": 0.5}, []), ({"bias": -0.3}, ["bias"]), ({"coverage": 0.5}, ["coverage"]), ({"psi": 0.3}, ["drift"]), ({"ks": 0.25}, ["drift"]),
    ({"planning_bias": 0.2}, ["planning_bias"]), ({"promo_wmape": 0.6}, ["promo_wmape"]), ({"fva": -8.0}, ["fva"]), ({"fva": -7.9}, []), ({"completeness": 0.8}, ["completeness"]),
    ({"revision": 0.4}, ["revision"]), ({"run_coverage": 0.9}, ["run_coverage"]), ({"artifact_age": 20.0}, ["artifact_age"]), ({k: None for k in GOOD}, []),
])
def test_gate(spark, change, warning):
    row = spark.createDataFrame([tuple((GOOD | change).values())], ", ".join(f"{k} double" for k in GOOD))
    got = O.gate(row).first()
    assert got["warnings"] == warning and got["degraded"] == bool(warning)


def test_missing_measures_never_warn(spark):
    assert O.gate(spark.createDataFrame([(0.1,)], "wmape double")).first()["warnings"] == []


def test_chunk_states(spark):
    log = spark.createDataFrame([(1, 0, 1, "queued"), (1, 0, 2, "processing"), (1, 0, 3, "failed"), (1, 0, 4, "completed"), (1, 1, 1, "queued"), (1, 1, 2, "completed"), (2, 0, 1, "queued"), (2, 0, 2, "processing"), (2, 0, 3, "completed")], "run_id long, idx long, seq int, status string")
    states = R.chunk_state(log)
    assert {(r["run_id"], r["idx"]): r["status"] for r in states.collect()} == {(1, 0): "failed", (1, 1): "queued", (2, 0): "completed"}
    assert {r["run_id"]: r["status"] for r in R.run_status(states).collect()} == {1: "processing", 2: "completed"}


def test_fallback_takes_the_whole_series(spark):
    day = MONDAY
    points = spark.createDataFrame([(1, "a", day, 1, 1.0, 2.0, 3.0), (1, "a", day, 2, 1.0, 1e9, 3.0), (1, "b", day, 1, 1.0, 2.0, 3.0)], "run_id long, series_id string, week_start_date date, h int, p10 double, p50 double, p90 double")
    level = spark.createDataFrame([("a", 4.0), ("b", 5.0)], "series_id string, level double")
    got = {(r["series_id"], r["h"]): (r["p10"], r["p50"], r["p90"]) for r in B.apply_fallback(points, level.withColumnRenamed("level", "scale"), level).collect()}
    assert got == {("a", 1): (2.0, 4.0, 6.0), ("a", 2): (2.0, 4.0, 6.0), ("b", 1): (1.0, 2.0, 3.0)}


def test_contracts_count_and_stop(spark):
    bad = spark.createDataFrame([(1.0, 2.0, 3.0, 1), (5.0, 2.0, 3.0, 1), (-1.0, 2.0, 3.0, 0)], "p10 double, p50 double, p90 double, h int")
    got = C.violations(bad, C.OUTPUT).first()
    assert (got["n_rows"], got["p10_negative"], got["not_monotone"], got["h_range"]) == (3, 1, 1, 1)
    with pytest.raises(Exception, match="contract"):
        C.enforce(bad, C.OUTPUT).collect()


def test_an_update_wins_a_tie(spark):
    from harvestline.operators import etl

    old = spark.createDataFrame([("a", 1, 1.0), ("b", 2, 1.0), ("c", 1, 1.0)], "k string, v int, x double")
    new = spark.createDataFrame([("a", 1, 9.0), ("b", 1, 9.0), ("d", 1, 9.0)], "k string, v int, x double")
    got = {r["k"]: r["x"] for r in etl.upsert(old, new, ["k"], "v").collect()}
    assert got == {"a": 9.0, "b": 1.0, "c": 1.0, "d": 9.0}
