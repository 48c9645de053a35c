"""Queries that write and read back: stores, memos, CSV scans and exports, metric files, ripening forecasts, retraining."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import r4
from harvestline.operators import contracts as C
from harvestline.operators import etl as L
from harvestline.operators import metrics as M
from harvestline.operators import models as ML
from harvestline.operators import monitoring as O
from harvestline.operators import runs as R
from harvestline.operators.boosting import Model
from harvestline.operators.retrain import Artifacts, retrain
from harvestline.plans import learned as LE
from harvestline.plans import queries as Q
from harvestline.sources import retail as S
from harvestline.sources import store as W
from harvestline.sources.shared import cut, shared_folder
from harvestline.streaming import drain
from harvestline.streaming.maturation import matured

STORED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def stored(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    STORED[f.__name__] = f
    return f


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = cut(S.panel(spark, sf))
    return p, cut(S.points(p, S.runs(p)))


@stored
def stored_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points loaded once and upserted once, however often both are asked for, and merged as they are read."""
    _, q = _points(spark, sf)
    schema = "series_id string, week_start_date date, run_id long, p50 double"
    table = W.Store(spark, place(spark, "points"), schema, ["series_id", "week_start_date"], "run_id")
    newer = Q.last_run(q).select("series_id", "week_start_date", (F.col("run_id") + 1).alias("run_id"), (F.col("p50") + 1).alias("p50"))
    for _ in range(2):
        table.load(q)
        table.upsert(newer, "run 7")
    return table.read()


@stored
def memo_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as the second asking for it finds it."""
    folder = place(spark, "memo")
    W.memo(S.panel(spark, sf), folder, "panel")
    return W.memo(S.panel(spark, sf), folder, "panel")


@stored
def csv_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar from a typed scan of CSV."""
    days, folder = S.calendar_days(spark, sf), place(spark, "calendar")
    W.write_csv(days, folder)
    schema = ", ".join(f"{c} {t}" for c, t in days.dtypes)
    return L.calendar(S.read_csv(spark, folder, schema)).select("date", "d_num", "week_start_date", "has_event", "snap_a")


@stored
def csv_prices(spark: SparkSession, sf: str) -> DataFrame:
    folder = place(spark, "prices")
    W.write_csv(Q.weekly_prices(spark, sf), folder)
    return S.read_csv(spark, folder, "store_id string, item_id string, wm_yr_wk date, sell_price double").select("store_id", "item_id", "wm_yr_wk", r4("sell_price").alias("sell_price"))


@stored
def csv_wide_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Wide sales, a column a weekday, from CSV to rows with an id."""
    folder = place(spark, "wide")
    rows = S.sales(spark, sf).withColumn("wday", F.weekday("day") + 1)
    W.write_csv(rows.groupBy("item_id", "state_id").agg(*(F.coalesce(F.sum(F.when(F.col("wday") == d, F.col("l_quantity"))), F.lit(0)).cast("long").alias(f"d_{d}") for d in range(1, 8))), folder)
    names = spark.createDataFrame([(d, d >= 6) for d in range(1, 8)], "d_num int, weekend boolean")
    return L.melt_daily(W.read_wide_sales(spark, folder, 7, ("item_id", "state_id")), ["id", "item_id", "state_id"], names)


@stored
def slice_copy(spark: SparkSession, sf: str) -> DataFrame:
    """One category of the panel, written by category as Snappy Parquet and read by its partition alone."""
    folder = place(spark, "slice")
    S.write_slice(S.panel(spark, sf), folder)
    return spark.read.parquet(folder).filter("cat_id = 'C0'").select("id", "week_start_date", "units")


@stored
def export_csv(spark: SparkSession, sf: str) -> DataFrame:
    p, q = _points(spark, sf)
    folder, rows = place(spark, "export"), R.export_rows(Q.last_run(q), L.series_dim(p))
    W.write_csv(rows, folder)
    return S.read_csv(spark, folder, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


@stored
def metric_files(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and deviation of the models' folds, as JSON and as CSV, read back."""
    folder = place(spark, "metrics")
    W.write_metrics(Q.QUERIES["cv_summary"](spark, sf), folder)
    return W.read_metrics(spark, folder, "model string, mean double, std double")


@stored
def forecast_maturation(spark: SparkSession, sf: str) -> DataFrame:
    """Points of all runs as streams bring the weeks that they forecast: their units, or null where the week came over 14 days late or never.

    Every fifth week of the year comes three weeks late. The stream runs three times as more comes, the last time for a tick on both sides far ahead.
    """
    p, q = _points(spark, sf)
    folder = place(spark, "ripen")
    end = lambda c: (F.date_add(c, 7)).cast("timestamp")
    points = q.select("run_id", "series_id", "week_start_date", "h", "p50", end(F.col("week_start_date")).alias("due"))
    late = F.when(F.weekofyear("week_start_date") % 5 == 0, 21).otherwise(0)
    weeks = p.filter("n_days = 7").join(points.select("week_start_date").distinct(), "week_start_date", "left_semi")
    arrivals = weeks.select("id", F.col("week_start_date").alias("week"), "units", F.date_add("week_start_date", 7 + late).cast("timestamp").alias("at"))
    tick = spark.range(1).select(F.lit("tick").alias("name"), F.to_timestamp(F.lit("2100-01-01")).alias("time"))
    ticks = {"points": tick.select(F.lit(None).cast("long").alias("run_id"), F.col("name").alias("series_id"), F.lit(None).cast("date").alias("week_start_date"), F.lit(None).cast("int").alias("h"), F.lit(None).cast("double").alias("p50"), F.col("time").alias("due"))}
    ticks["arrivals"] = tick.select(F.col("name").alias("id"), F.to_date("time").alias("week"), F.lit(None).cast("long").alias("units"), F.col("time").alias("at"))
    sides = {"points": (cut(points), "due"), "arrivals": (cut(arrivals), "at")}
    middle = points.agg(F.percentile_approx(F.unix_seconds("due"), 0.5)).first()[0]  # a time
    # Three runs of the same stream: the older half of both sides, the newer one, the tick.
    for number in range(3):
        streams = {}
        for name, (rows, time) in sides.items():
            old = F.unix_seconds(time) <= F.lit(middle)
            (ticks[name] if number == 2 else rows.filter(~old if number else old)).write.mode("append").parquet(f"{folder}/{name}")
            streams[name] = spark.readStream.schema(rows.schema).parquet(f"{folder}/{name}")
        drain(matured(streams["points"], streams["arrivals"]), f"{folder}/out", f"{folder}/state")
    out = spark.read.parquet(f"{folder}/out").filter("run_id is not null")
    return out.select("run_id", "series_id", "week_start_date", "h", r4("p50").alias("p50"), "units", F.col("units").isNotNull().alias("matured"))


@stored
def retrain_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run of the driver over the panel: contracts, a booster, its WRMSSE on the last eight weeks, the gate, the pointer."""
    fixture = LE.Fixture(spark, sf)
    artifacts = Artifacts(spark, place(spark, "artifacts"), fixture.binning.features)

    def backtest(model: Model) -> float:
        return M.model_metrics(M.score_models(fixture.train, fixture.actual, {"point": fixture.forecast(model, "point")})).first()["wrmsse12"]

    log = retrain(artifacts, C.violations(fixture.panel, C.WEEKLY), lambda: fixture.train_boosters([LE.POINT], 4), backtest, O.DEPLOY_WRMSSE)
    return spark.createDataFrame(log, "step string, ok boolean, detail string")
