"""Queries of the boosted forecasters: forecasts with intervals, scores beside the simpler models, ablations, parts, gains, search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestline.functions import r4
from harvestline.operators import baselines as B
from harvestline.operators import features as X
from harvestline.operators import metrics as M
from harvestline.operators import models as ML
from harvestline.operators import pooling as P
from harvestline.operators.boosting import Model, Params, Training, fit_binning
from harvestline.operators.search import Fold, candidates, halving, on_folds
from harvestline.sources import retail as S
from harvestline.sources.shared import cut

LEARNED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

POINT = Params("point", depth=4, leaves=16, rate=0.35)
QUANTILES = [Params(f"q{round(100 * q)}", "quantile", alpha=q, depth=4, leaves=16, rate=0.35, weighted=False) for q in (0.1, 0.5, 0.9)]
TREES = 8


def learned(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LEARNED[f.__name__] = f
    return f


class Fixture:
    """The panel, the frame of the boosters (cut to the weeks in use) and what is held out of them."""

    def __init__(self, spark: SparkSession, sf: str, weeks: int = 104) -> None:
        self.panel = cut(S.panel(spark, sf))
        self.train, self.actual = S.holdout(self.panel)
        frame = S.with_back(ML.boost_frame(self.panel)).filter(F.col("back") <= 16 + weeks)
        # Beside the training weeks only the row of each week's own horizon is forecast.
        self.frame = cut(frame.filter("back > 16 or back = 9 - h or back = 17 - h"))
        self.binning = fit_binning(self.learned_from(), ML.BOOST_NUMERIC, ML.BOOST_CATEGORIES)

    def learned_from(self, after: int = 16) -> DataFrame:
        return self.frame.filter((F.col("back") > after) & (F.col("available_days") > 0) & F.col("lag_1").isNotNull())

    def calibration(self) -> DataFrame:
        return self.frame.filter("back between 9 and 16 and back = 17 - h")

    def test(self) -> DataFrame:
        return self.frame.filter("back <= 8 and back = 9 - h")

    def train_boosters(self, params: list[Params], trees: int = TREES) -> Model:
        return Training(self.learned_from(), self.binning, params, order="back").grow(trees).model()

    def forecast(self, model: Model, name: str) -> DataFrame:
        """The booster's forecast of the test weeks, calibrated on the weeks before them."""
        made = lambda rows: ML.masked(model.transform(rows, {name: "raw"}))
        return B.calibrated(made(self.test()), made(self.calibration()))


@learned
def boosted_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Point and interval of each series and week: the calibrated Tweedie booster within the quantile boosters, runaways replaced."""
    fixture = Fixture(spark, sf)
    model = fixture.train_boosters([POINT, QUANTILES[0], QUANTILES[2]])
    point = fixture.forecast(model, "point").select(F.col("id").alias("series_id"), "week_start_date", "h", F.col("pred").alias("p50"))
    around = ML.boosted_quantiles(model, fixture.test(), "q10", "q90").select("series_id", "week_start_date", "q10", "q90")
    points = point.join(around, ["series_id", "week_start_date"]).withColumns({"p10": F.least("q10", "p50"), "p90": F.greatest("q90", "p50"), "run_id": F.lit(1).cast("long")})
    named = lambda df: df.withColumnRenamed("id", "series_id")
    return B.apply_fallback(points.drop("q10", "q90"), named(B.last_rows_peak(fixture.train)), named(B.last_rows_level(fixture.train))).drop("run_id", "bad")


#: Variants of an ablation: the objective, and groups of features that the booster does without.
VARIANTS = [
    POINT, Params("l2", "l2", depth=4, leaves=16, rate=0.35), Params("no_events", depth=4, leaves=16, rate=0.35, without=ML.BOOST_GROUPS["events"]),
    Params("no_promo", depth=4, leaves=16, rate=0.35, without=ML.BOOST_GROUPS["promo"]), Params("no_cross", depth=4, leaves=16, rate=0.35, without=("item_rmean_4", "dept_rmean_4")),
]


@learned
def boosted_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The ladder: moving average, linear Tweedie model, booster with and without calibration, and the booster's variants, scored alike."""
    fixture = Fixture(spark, sf)
    model = fixture.train_boosters(VARIANTS)
    linear = ML.fit_tweedie(ML.prepare(fixture.learned_from()))
    glm = B.calibrated(ML.predict(linear, ML.prepare(fixture.test())), ML.predict(linear, ML.prepare(fixture.calibration())))
    models = {"ma4": B.moving_average(fixture.train, fixture.actual), "glm": glm, "point_raw": ML.masked(model.transform(fixture.test(), {"point": "raw"}))}
    models |= {p.name: fixture.forecast(model, p.name) for p in VARIANTS}
    metrics = M.model_metrics(M.score_models(fixture.train, fixture.actual, models))
    return metrics.select("model", *(r4(c).alias(c) for c in metrics.columns if c != "model"))


@learned
def boosted_quantile_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Pinball loss and coverage of the quantile boosters beside quantiles of ratios around the linear model."""
    fixture = Fixture(spark, sf)
    boosted = ML.boosted_quantiles(fixture.train_boosters(QUANTILES), fixture.test(), "q10", "q50", "q90")
    boosted = boosted.select("series_id", "week_start_date", F.col("q10").alias("p10"), F.col("q50").alias("p50"), F.col("q90").alias("p90"))
    linear = ML.fit_tweedie(ML.prepare(fixture.learned_from()))
    made = lambda rows: ML.predict(linear, ML.prepare(rows))
    calibration = made(fixture.calibration())
    ratios = ML.interval(B.calibrated(made(fixture.test()), calibration), B.calibrated(calibration, calibration))
    both = M.quantile_metrics(boosted, fixture.actual).withColumn("model", F.lit("boosted")).unionByName(M.quantile_metrics(ratios, fixture.actual).withColumn("model", F.lit("ratios")))
    return both.select("model", *(r4(c).alias(c) for c in both.columns if c != "model"))


@learned
def boosted_decompose(spark: SparkSession, sf: str) -> DataFrame:
    """The booster's forecast of each row as a base and what promotion, season and events add to it."""
    fixture = Fixture(spark, sf)
    model = fixture.train_boosters([POINT])
    return ML.decompose(lambda rows: model.transform(rows, {"point": "raw"}), fixture.test(), ML.BOOST_NEUTRAL)


@learned
def boosted_gain(spark: SparkSession, sf: str) -> DataFrame:
    """The features' shares of the booster's gain, most first."""
    gains = Fixture(spark, sf).train_boosters([POINT]).gains("point")
    return spark.createDataFrame([(k, round(v, 4)) for k, v in gains.items()], "feature string, percent double").orderBy(F.desc("percent"), "feature")


def search(fixture: Fixture, n: int = 4, seed: int = 11, rungs: tuple[int, ...] = (3, 3, 4)) -> list[tuple[int, str, int, float, bool]]:
    """Successive halving over two folds: the eight weeks before the test weeks, and the eight before those."""
    folds, default = [Fold("near", 16.0), Fold("far", 24.0)], POINT
    tried = candidates(n, seed, default)
    rows = {"near": fixture.calibration(), "far": fixture.frame.filter("back between 17 and 24 and back = 25 - h")}
    panel = S.with_back(fixture.panel)
    spans = {"near": (panel.filter("back > 16").drop("back"), panel.filter("back between 9 and 16").drop("back")), "far": (panel.filter("back > 24").drop("back"), panel.filter("back between 17 and 24").drop("back"))}

    def score(training: Training, names: list[str]) -> dict[str, float]:
        model, out = training.model(), {}
        for fold, (train, actual) in spans.items():
            mine = [b for b in names if b.endswith(f"@{fold}")]
            made = cut(model.transform(rows[fold], {b: f"raw_{k}" for k, b in enumerate(mine)}))
            preds = {b: ML.masked(made.withColumn("raw", F.col(f"raw_{k}"))) for k, b in enumerate(mine)}
            levels = M.model_metrics(M.score_models(train, actual, preds)).select("model", "wrmsse12").collect()
            out |= {r["model"]: r["wrmsse12"] for r in levels}
        return out

    training = Training(fixture.learned_from(), fixture.binning, on_folds(tried, folds), order="back")
    return halving(training, [p.name for p in tried], folds, list(rungs), score)


@learned
def boosted_search(spark: SparkSession, sf: str) -> DataFrame:
    """The search's log: rung, candidate, trees, mean WRMSSE of the folds, and whether it went on."""
    log = search(Fixture(spark, sf))
    return spark.createDataFrame([(r, c, t, round(s, 4), k) for r, c, t, s, k in log], "rung int, candidate string, trees int, wrmsse double, kept boolean")


def pooled(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Forecasts of rows by the departments' partially pooled shapes over levels of eight weeks."""
    level, end = B.ma_level(train, 8), train.agg(F.max("week_start_date").alias("end"))
    shapes = P.fit(P.gram(B.group_ratio(train, level).filter("ratio > 0"), "dept_id", end), "dept_id")
    return P.forecast(shapes, rows, level, "dept_id", end)


@learned
def pooled_forecast(spark: SparkSession, sf: str) -> DataFrame:
    train, actual = S.holdout(cut(S.panel(spark, sf)))
    out = pooled(train, actual)
    return out.select(F.col("id").alias("series_id"), "week_start_date", *(r4(c).alias(n) for c, n in (("p10", "p10"), ("pred", "p50"), ("p90", "p90"))))


@learned
def pooled_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The pooled shapes beside the moving average of as many weeks and IMAPA."""
    train, actual = S.holdout(cut(S.panel(spark, sf)))
    flat = actual.join(B.imapa(train), "id").select("id", "week_start_date", F.col("rate").alias("pred"))
    models = {"ma8": B.moving_average(train, actual, 8), "pooled": cut(pooled(train, actual)), "imapa": flat}
    metrics = M.model_metrics(M.score_models(train, actual, models))
    return metrics.select("model", *(r4(c).alias(c) for c in metrics.columns if c != "model"))
