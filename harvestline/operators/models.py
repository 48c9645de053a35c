"""Learned forecasters on Spark ML, and their evaluation by folds.

Gradient boosting with a Tweedie loss is not in Spark ML: a generalised linear Tweedie model on the same features stands in for it, the
quantiles come from the ratios of actual to forecast units on the calibration weeks, and a ridge regression on Fourier terms
stands in for the hierarchical Bayesian model of group ratios.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.functions import ratio
from harvestline.operators.boosting import Model
from harvestline.operators.features import LAGS, MEANS, build_direct, calendar_features, prices

NUMERIC = [*(f"log_lag_{k}" for k in LAGS[:5]), *(f"log_rmean_{m}" for m in MEANS), "nz_share_4", "nz_share_13", "woy_sin", "woy_cos", "snap_days", "event_days", "h"]
#: What a part of the forecast is without: the columns of each feature group and their neutral values.
NEUTRAL = {"seasonality": {"woy_sin": 0.0, "woy_cos": 0.0}, "events": {"event_days": 0.0, "snap_days": 0.0}}


def prepare(frame: DataFrame) -> DataFrame:
    """Logarithms of counts, so that a log link is close to linear in them; unknown values are 0."""
    woy = F.weekofyear("week_start_date")
    logs = {f"log_{c}": F.log1p(F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in [*(f"lag_{k}" for k in LAGS[:5]), *(f"rmean_{m}" for m in MEANS)]}
    rest = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("nz_share_4", "nz_share_13", "snap_days", "event_days")}
    return frame.withColumns(logs | rest | {"woy_sin": F.sin(2 * math.pi * woy / 52), "woy_cos": F.cos(2 * math.pi * woy / 52), "label": F.col("units").cast("double"), "weight": F.log1p("revenue") + 0.01})


def fit_tweedie(frame: DataFrame, power: float = 1.1, ridge: float = 1e-3) -> PipelineModel:
    stages = [
        StringIndexer(inputCol="dept_id", outputCol="dept", handleInvalid="keep"),
        OneHotEncoder(inputCol="dept", outputCol="dept_is"),  # the unknown department is the one that is left out
        VectorAssembler(inputCols=[*NUMERIC, "dept_is"], outputCol="features"),
        GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, regParam=ridge, weightCol="weight", maxIter=8, predictionCol="raw"),
    ]
    return Pipeline(stages=stages).fit(frame)


def save(model: PipelineModel, folder: str, trained_at: dt.datetime) -> None:
    """The model, and beside it the features that it reads and when it was trained."""
    about = SparkSession.active().createDataFrame([(NUMERIC, trained_at)], "features array<string>, trained_at timestamp")
    model.write().overwrite().save(f"{folder}/model")
    about.write.mode("overwrite").parquet(f"{folder}/about")


def load(folder: str, features: list[str] = NUMERIC) -> PipelineModel:
    """A saved model; one that reads other features than the caller has is refused."""
    found = SparkSession.active().read.parquet(f"{folder}/about").first()["features"]
    if found != features:
        raise ValueError(f"the model reads {found}, not {features}")
    return PipelineModel.load(f"{folder}/model")


def artifact_age(folder: str, now: dt.datetime) -> DataFrame:
    """One row: days since the saved model was trained."""
    seconds = F.unix_timestamp(F.lit(now)) - F.unix_timestamp("trained_at")
    return SparkSession.active().read.parquet(f"{folder}/about").select((seconds / 86400).alias("artifact_age"))


def importance(model: PipelineModel, frame: DataFrame, top: int = 15) -> DataFrame:
    """feature, shap, percent of the features that move the linear predictor most.

    shap is the mean absolute Shapley value, which for a linear model is the coefficient times the mean distance from the feature's mean; the
    department's is that of all its columns together.
    """
    n, weights = len(NUMERIC), [float(b) for b in model.stages[-1].coefficients]
    names, beta = [*NUMERIC, "dept"], [*weights[:n], 1.0]
    dept = sum((F.col("x")[n + k] * w for k, w in enumerate(weights[n:])), F.lit(0.0))
    x = model.transform(frame).select(vector_to_array("features").alias("x")).select(*(F.col("x")[k].alias(c) for k, c in enumerate(NUMERIC)), dept.alias("dept"))
    means = x.agg(*(F.avg(n).alias(f"mean_{n}") for n in names))
    far = x.crossJoin(F.broadcast(means)).agg(*((abs(beta[k]) * F.avg(F.abs(F.col(n) - F.col(f"mean_{n}")))).alias(n) for k, n in enumerate(names)))  # one row each
    long = far.unpivot([], names, "feature", "shap")  # a row a feature
    return long.withColumn("percent", 100 * ratio(F.col("shap"), F.sum("shap").over(Window.partitionBy()))).orderBy(F.desc("shap"), "feature").limit(top)


def predict(model: PipelineModel, frame: DataFrame, factor: float = 1.0) -> DataFrame:
    """id, week, h, pred: never negative, 0 where nothing was available; runaway forecasts are left to the fallback."""
    pred = F.when(F.col("available_days") == 0, 0.0).otherwise(F.greatest("raw", F.lit(0.0)) * factor)
    return model.transform(frame).select("id", "dept_id", "week_start_date", "h", "units", pred.alias("pred"))


def interval(pred: DataFrame, calibration: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """p10, p50, p90: p50 times the exact quantiles of actual over forecast units, by department, on the calibration weeks."""
    r = calibration.withColumn("r", ratio(F.col("units"), F.col("pred"))).filter("r is not null")
    q = r.groupBy("dept_id").agg(F.percentile("r", F.array(F.lit(low), F.lit(high))).alias("q"))
    joined = pred.join(F.broadcast(q), "dept_id", "left")
    p10, p90 = F.least("pred", F.col("pred") * F.coalesce(F.col("q")[0], F.lit(0.5))), F.greatest("pred", F.col("pred") * F.coalesce(F.col("q")[1], F.lit(1.5)))
    return joined.select(F.col("id").alias("series_id"), "week_start_date", "h", p10.alias("p10"), F.col("pred").alias("p50"), p90.alias("p90"))


def decompose(forecast: Callable[[DataFrame], DataFrame], frame: DataFrame, neutral: dict[str, dict[str, float]] = NEUTRAL, keys: tuple[str, ...] = ("id", "week_start_date", "h")) -> DataFrame:
    """The forecast (a column raw) as a base and what each feature group adds to it; the parts sum to the whole.

    Each row is forecast as it is and once without each group, side by side: no join.
    """
    columns = [c for values in neutral.values() for c in values]
    value = lambda c, values: (F.lit(values[c]) if c in values else F.col(c)).cast("double").alias(c)
    copies = F.array(*(F.struct(F.lit(name).alias("without"), *(value(c, values) for c in columns)) for name, values in ({"": {}} | neutral).items()))
    rest = [c for c in frame.columns if c not in columns]
    raw = forecast(frame.withColumn("copy", F.explode(copies)).select(*rest, "copy.*"))
    of = lambda name: F.max(F.when(F.col("without") == name, F.col("raw")))
    out = raw.groupBy(*keys).agg(of("").alias("total"), *((of("") - of(name)).alias(name) for name in neutral))
    base = F.col("total")
    for name in neutral:
        base = base - F.col(name)
    return out.select(*keys, base.alias("base"), *neutral, "total")


def decompose_series(forecast: Callable[[DataFrame], DataFrame], frame: DataFrame, item: str, store: str, neutral: dict[str, dict[str, float]] = NEUTRAL) -> DataFrame:
    """The parts of one item in one store, by week; a series that the frame lacks is an error."""
    rows = frame.filter((F.col("item_id") == item) & (F.col("store_id") == store))
    if rows.isEmpty():
        raise ValueError(f"no series of {item} in {store}")
    return decompose(forecast, rows, neutral).orderBy("week_start_date", "h")


#: Features of the boosters.
BOOST_NUMERIC = [
    *(f"lag_{k}" for k in LAGS), *(f"rmean_{m}" for m in MEANS), "rstd_13", "rmax_13", "nz_share_4", "nz_share_13", "item_rmean_4", "dept_rmean_4", "h",
    "sell_price", "price_rel", "disc_pct", "is_promo", "weeks_since_promo", "woy_sin", "woy_cos", "month", "is_year_end", "snap_days", "event_days", "age_weeks",
]
BOOST_CATEGORIES = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
#: What a part of a booster's forecast is without; fixed values.
BOOST_NEUTRAL = {
    "promo": {"is_promo": 0.0, "disc_pct": 0.0, "price_rel": 1.0, "weeks_since_promo": 52.0},
    "seasonality": {"woy_sin": 0.0, "woy_cos": 0.0, "is_year_end": 0.0, "month": 6.0},
    "events": {"event_days": 0.0, "snap_days": 0.0},
}
BOOST_GROUPS = {name: tuple(values) for name, values in BOOST_NEUTRAL.items()}


def boost_frame(panel: DataFrame) -> DataFrame:
    """The multi-horizon frame with the target week's price, promotion and calendar features, label, and weight log(1 + revenue)."""
    known = calendar_features(prices(panel)).withColumn("disc_pct", 100 * (F.col("price_rel") - 1))
    weight = F.log1p(F.greatest(F.coalesce("revenue", F.lit(0.0)), F.lit(0.0)))
    return build_direct(known).withColumns({"label": F.col("units").cast("double"), "weight": weight})


def masked(frame: DataFrame) -> DataFrame:
    """id, dept_id, week, h, units, pred of a frame with raw forecasts: never negative, 0 where nothing was available."""
    pred = F.when(F.col("available_days") == 0, 0.0).otherwise(F.greatest("raw", F.lit(0.0)))
    return frame.select("id", "dept_id", "week_start_date", "h", "units", pred.alias("pred"))


def boosted_quantiles(model: Model, frame: DataFrame, *names: str) -> DataFrame:
    """series_id, week, h and the quantile boosters' forecasts in order: never negative, sorted within a row, 0 where nothing was available."""
    made = model.transform(frame, {n: n for n in names})
    zero = F.when(F.col("available_days") == 0, F.array(*(F.lit(0.0) for _ in names))).otherwise(F.array_sort(F.array(*(F.greatest(n, F.lit(0.0)) for n in names))))
    return made.withColumn("q", zero).select(F.col("id").alias("series_id"), "week_start_date", "h", *(F.col("q")[k].alias(n) for k, n in enumerate(names)))


def fit_fourier(ratios: DataFrame, harmonics: int = 5, ridge: float = 0.1) -> PipelineModel:
    """Ridge regression of the log group ratio on Fourier terms of the week of the year."""
    return Pipeline(stages=[VectorAssembler(inputCols=[f"{f}{k}" for k in range(1, harmonics + 1) for f in ("sin", "cos")], outputCol="x"), LinearRegression(featuresCol="x", labelCol="y", regParam=ridge, elasticNetParam=0.0)]).fit(fourier(ratios, harmonics))


def fourier(rows: DataFrame, harmonics: int = 5) -> DataFrame:
    angle = 2 * math.pi * F.weekofyear("week_start_date") / 52.18
    terms = {f"{name}{k}": f(k * angle) for k in range(1, harmonics + 1) for name, f in (("sin", F.sin), ("cos", F.cos))}
    return rows.withColumns(terms | {"y": F.ln("ratio")} if "ratio" in rows.columns else terms)


def cold_split(panel: DataFrame, percent: int = 5) -> DataFrame:
    """cold marks a fixed share of the items, by a hash that other engines have too."""
    mark = F.conv(F.substring(F.md5("item_id"), 1, 6), 16, 10).cast("long") % 100 < percent
    return panel.withColumn("cold", mark)


def folds(weeks: DataFrame, n: int = 4, step: int = 8, horizon: int = 8) -> DataFrame:
    """fold, origin, calibration origin, last week: walk-forward windows, oldest first; weeks has back, 1 for the last."""
    at = lambda name: weeks.select(F.col("back").alias(f"b_{name}"), F.col("week_start_date").alias(name))
    k = weeks.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).distinct().withColumn("end_back", F.col("k") * step + 1)
    out = k.join(at("end"), F.col("end_back") == F.col("b_end"))
    out = out.join(at("origin"), F.col("end_back") + horizon == F.col("b_origin")).join(at("cal_origin"), F.col("end_back") + 2 * horizon == F.col("b_cal_origin"))
    return out.select((n - F.col("k")).alias("fold"), "origin", "cal_origin", "end")
