"""One query for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.functions import r4, ratio
from harvestline.operators import baselines as B
from harvestline.operators import contracts as C
from harvestline.operators import eda as E
from harvestline.operators import etl as L
from harvestline.operators import features as X
from harvestline.operators import metrics as M
from harvestline.operators import models as ML
from harvestline.operators import monitoring as O
from harvestline.operators import runs as R
from harvestline.sources import retail as S
from harvestline.sources.shared import cut
from harvestline.streaming import hist_quantile, stream_rate, stream_score
from harvestline.streaming.alerts import counter_rate, sustained_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STATES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def on_panel(name: str, f: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: f(S.panel(spark, sf))


def on_holdout(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf: f(*S.holdout(S.panel(spark, sf)))


def on_runs(name: str, f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = S.panel(spark, sf)
        r = S.runs(p)
        return f(p, r, S.points(p, r))

    QUERIES[name] = run


def last_run(points: DataFrame) -> DataFrame:
    return points.filter(F.col("run_id") == S.RUNS)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r4(n) for n in names})


# Scans, calendar, weekly panel
@query
def calendar_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return L.calendar(S.calendar_days(spark, sf)).select("date", "d_num", "week_start_date", "has_event", "snap_a")


QUERIES["weekly_calendar"] = lambda spark, sf: L.weekly_calendar(L.calendar(S.calendar_days(spark, sf)))
QUERIES["weekly_events"] = lambda spark, sf: L.weekly_events(L.calendar(S.calendar_days(spark, sf)))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return S.sales(spark, sf).groupBy("item_id", "store_id", "state_id", F.col("day").alias("date")).agg(F.sum("l_quantity").cast("long").alias("units"), F.sum("revenue").alias("paid"))


def cents(value: Column, places: int) -> Column:
    """value to the nearest 1 / places, by operations that all engines do alike (round() takes halves in several ways)."""
    return F.floor(value * places + 0.5) / places


def weekly_prices(spark: SparkSession, sf: str) -> DataFrame:
    """A price in cents for each item, store and week in which over 20 were sold; others have none. What was paid is summed exactly."""
    rows = daily(spark, sf).withColumn("week_start_date", F.to_date(F.date_trunc("week", "date"))).groupBy("store_id", "item_id", "week_start_date").agg(F.sum("units").alias("u"), F.sum("paid").alias("p"))
    return rows.filter("u > 20").select("store_id", "item_id", F.col("week_start_date").alias("wm_yr_wk"), cents(F.col("p").cast("double") / F.col("u"), 100).alias("sell_price"))


@query
def melt_daily(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sales(spark, sf).withColumn("wday", F.weekday("day") + 1)
    wide = rows.groupBy("item_id", "state_id").agg(*(F.coalesce(F.sum(F.when(F.col("wday") == d, F.col("l_quantity"))), F.lit(0)).cast("long").alias(f"d_{d}") for d in range(1, 8)))
    names = spark.createDataFrame([(d, d >= 6) for d in range(1, 8)], "d_num int, weekend boolean")
    return L.melt_daily(wide, ["item_id", "state_id"], names)


@query
def snap_by_state(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sales(spark, sf).select("state_id", F.col("day").alias("date")).distinct().join(S.calendar_days(spark, sf), "date")
    return L.snap_by_state(rows).select("state_id", "date", "snap")


def priced_days(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily(spark, sf).withColumn("wm_yr_wk", F.to_date(F.date_trunc("week", "date")))
    return L.join_prices(rows, weekly_prices(spark, sf))


QUERIES["join_prices"] = lambda spark, sf: priced_days(spark, sf).select("item_id", "store_id", "date", "units", "sell_price", "available", F.round("revenue", 2).alias("revenue"))
QUERIES["weekly_panel"] = lambda spark, sf: rounded(L.weekly_rollup(priced_days(spark, sf), ["item_id", "store_id", "state_id", "wm_yr_wk"]), "revenue", "sell_price").drop("wm_yr_wk")
on_panel("dense_panel", lambda p: p)
on_panel("load_window", lambda p: L.load_window(p, 14).select("id", "week_start_date", "units"))
on_panel("category_slice", lambda p: p.filter("cat_id = 'C0'").select("id", "week_start_date", "units"))
on_panel("series_dim", L.series_dim)


@query
def add_events(spark: SparkSession, sf: str) -> DataFrame:
    p = S.panel(spark, sf).select("id", "week_start_date", "units")
    return L.add_events(p, L.weekly_events(L.calendar(S.calendar_days(spark, sf))))


@query
def read_history(spark: SparkSession, sf: str) -> DataFrame:
    p = S.with_back(S.panel(spark, sf))
    return p.filter("back >= 9 and back < 9 + 79 and n_days = 7 and store_id in ('NATION_1', 'NATION_2', 'NATION_3')").select("id", "week_start_date", "units", "sell_price")


on_panel("stores", lambda p: p.select("store_id", "state_id").distinct())
on_panel("item_dept_weekly", lambda p: p.groupBy("item_id", "dept_id", "week_start_date").agg(F.sum("units").alias("units")))

# Features
on_panel("feat_lags", lambda p: X.lags(p).select("id", "week_start_date", *(f"lag_{k}" for k in X.LAGS)))
on_panel("feat_rolling", lambda p: rounded(X.rolling(p, 2), *(f"rmean_{m}" for m in X.MEANS), "rstd_13").select("id", "week_start_date", *(f"rmean_{m}" for m in X.MEANS), "rstd_13", "rmax_13"))
on_panel("feat_nz", lambda p: rounded(X.nonzero_shares(p), "nz_share_4", "nz_share_13").select("id", "week_start_date", "nz_share_4", "nz_share_13"))
on_panel("feat_cross", lambda p: rounded(X.cross_series(p), "item_rmean_4", "dept_rmean_4").select("id", "week_start_date", "item_rmean_4", "dept_rmean_4"))
on_panel("feat_price", lambda p: X.prices(p).select("id", "week_start_date", "price_median", "price_rel", "is_promo", "weeks_since_promo"))
on_panel("feat_position", lambda p: X.position(p).select("id", "week_start_date", "position"))
on_panel("feat_calendar", lambda p: rounded(X.calendar_features(p), "woy_sin", "woy_cos").select("id", "week_start_date", "woy", "woy_sin", "woy_cos", "month", "is_year_end", "age_weeks"))
on_panel("cross_series", lambda p: X.cross_series(p).groupBy("item_id", "dept_id", "week_start_date").agg(F.max("item_units").alias("item_units"), F.max("dept_units").alias("dept_units")))
on_panel("feat_single_h", lambda p: rounded(X.rolling(X.lags(p, 1, (4, 5, 6, 8, 12, 13, 26, 52)), 4, (4, 8, 13), 8), "rmean_4", "rmean_8", "rmean_13", "rstd_8").select("id", "week_start_date", "lag_4", "lag_52", "rmean_4", "rmean_8", "rmean_13", "rstd_8"))
on_panel("build_direct", lambda p: X.build_direct(p).groupBy("id", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("lag_1").alias("lag_1"), F.sum("lag_52").alias("lag_52"), r4(F.sum("rmean_8")).alias("rmean_8"), r4(F.avg("rstd_13")).alias("rstd_13"), F.sum("rmax_13").alias("rmax_13"), r4(F.avg("nz_share_4")).alias("nz_share_4"), r4(F.sum("dept_rmean_4")).alias("dept_rmean_4")))


@query
def train_slice(spark: SparkSession, sf: str) -> DataFrame:
    p = S.panel(spark, sf)
    return X.train_slice(p.crossJoin(F.broadcast(S.origin_of(p))), F.col("origin"), 104).select("id", "week_start_date", "units")


@query
def select_test(spark: SparkSession, sf: str) -> DataFrame:
    p = S.panel(spark, sf)
    frame = X.build_direct(p).crossJoin(F.broadcast(S.origin_of(p)))
    return X.select_test(frame, F.col("origin")).select("id", "week_start_date", "h", "lag_1", r4("rmean_4").alias("rmean_4"))


# Baselines
on_holdout("ma_level", lambda t, a: B.ma_level(t))
on_holdout("moving_average", B.moving_average)
on_holdout("seasonal_naive", B.seasonal_naive)
on_holdout("seasonal_ma", lambda t, a: rounded(B.seasonal_ma(t, a), "pred"))
on_holdout("dept_seasonal_ma", lambda t, a: rounded(B.dept_seasonal_ma(t, a), "pred"))
on_holdout("croston", lambda t, a: rounded(B.croston(t), "rate"))
on_holdout("imapa", lambda t, a: rounded(B.imapa(t), "rate"))
on_holdout("ensemble", lambda t, a: B.ensemble(B.moving_average(t, a), B.seasonal_naive(t, a)))
on_holdout("predict_masked", lambda t, a: B.mask_unavailable(B.moving_average(t, a), a))
on_holdout("hybrid", lambda t, a: B.hybrid(B.seasonal_naive(t, a), B.moving_average(t, a), t))
on_holdout("calibration_factor", lambda t, a: rounded(B.calibration_factor(B.moving_average(t, a), a), "factor"))
on_holdout("seasonal_decompose", lambda t, a: rounded(B.seasonal_decompose(t), "seasonal"))
on_holdout("group_ratio", lambda t, a: rounded(B.group_ratio(t, B.ma_level(t)), "ratio"))
on_holdout("suspect_zeros", lambda t, a: B.suspect_zeros(t).agg(F.count_if("suspect").alias("n"), r4(F.avg(F.col("suspect").cast("double"))).alias("share")))
on_holdout("agg_ma_forecast", lambda t, a: rounded(B.group_forecast(t, a, "item_id"), "agg_pred"))
on_holdout("future_rows", lambda t, a: B.future_rows(t, 8).select("id", "week_start_date", "h", "sell_price", "available_days", "units"))


def future_with_calendar(spark: SparkSession, sf: str, history: DataFrame) -> DataFrame:
    """The rows of the eight weeks after the history, with the fixture calendar's columns."""
    weeks = L.weekly_calendar(L.calendar(S.calendar_days(spark, sf)))
    return B.with_calendar(B.future_rows(history, 8), weeks, {"ASIA": "snap_a_days"}, "snap_b_days")


@query
def future_calendar(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = S.holdout(S.panel(spark, sf))
    return future_with_calendar(spark, sf, t).select("id", "week_start_date", "h", "snap_days", "event_days")


@query
def future_features(spark: SparkSession, sf: str) -> DataFrame:
    t, _ = S.holdout(S.panel(spark, sf))
    frame = X.future_frame(t, future_with_calendar(spark, sf, t))
    return frame.select("id", "week_start_date", "h", "lag_1", r4("rmean_4").alias("rmean_4"), "sell_price", "available_days")


def reconciled(t: DataFrame, a: DataFrame) -> tuple[DataFrame, DataFrame]:
    bottom = B.seasonal_naive(t, a).join(a.select("id", "week_start_date", "item_id"), ["id", "week_start_date"])
    return bottom, B.group_forecast(t, a, "item_id")


on_holdout("reconcile_mo", lambda t, a: B.middle_out(*reconciled(t, a), "item_id").withColumn("pred", cents(F.col("pred"), 10_000)))


def _gap(t: DataFrame, a: DataFrame) -> DataFrame:
    bottom, group = reconciled(t, a)
    before = B.reconciled_gap(bottom, group, "item_id").select(F.lit("before").alias("stage"), r4("gap").alias("gap"))
    after = B.reconciled_gap(B.middle_out(bottom, group, "item_id"), group, "item_id").select(F.lit("after").alias("stage"), r4("gap").alias("gap"))
    return before.unionByName(after)


on_holdout("reconciled_gap", _gap)

# Metrics
on_holdout("level_agg", lambda t, a: rounded(M.level_agg(a), "revenue"))
on_holdout("naive_scale", lambda t, a: rounded(M.naive_scale(M.level_agg(t)), "scale", "abs_scale"))
on_holdout("level_weights", lambda t, a: rounded(M.level_weights(M.level_agg(t)), "weight"))
on_holdout("rmsse", lambda t, a: rounded(M.rmsse(t, a, B.moving_average(t, a)), "rmsse", "weight").drop("mase"))
on_holdout("rmsse_l12", lambda t, a: M.all_metrics(t, a, B.moving_average(t, a)).select(r4("rmsse_l12").alias("rmsse_l12")))
on_holdout("mase_l12", lambda t, a: M.all_metrics(t, a, B.moving_average(t, a)).select(r4("mase_l12").alias("mase_l12")))
on_holdout("bias", lambda t, a: rounded(M.bias(a, B.moving_average(t, a)), "bias"))
on_holdout("wrmsse", lambda t, a: rounded(M.wrmsse(M.rmsse(t, a, B.moving_average(t, a))), "wrmsse"))
on_holdout("wrmsse9", lambda t, a: rounded(M.wrmsse(M.rmsse(t, a, B.moving_average(t, a)), M.UNIQUE), "wrmsse"))


def models_of(t: DataFrame, a: DataFrame) -> dict[str, DataFrame]:
    return {"ma4": B.moving_average(t, a), "seasonal_naive": B.seasonal_naive(t, a), "seasonal_ma": B.seasonal_ma(t, a)}


def on_cut_holdout(name: str, f: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """For what reads the panel many times: it is made once."""
    QUERIES[name] = lambda spark, sf: f(*S.holdout(cut(S.panel(spark, sf))))


on_cut_holdout("score_models", lambda t, a: rounded(M.model_metrics(M.score_models(t, a, models_of(t, a))), "wrmsse12", "wrmsse9", "rmsse_l12", "mase_l12", "bias"))


def _reconcile_eval(t: DataFrame, a: DataFrame) -> DataFrame:
    """Bottom forecasts as they are and after middle-out reconciliation to items, scored over all levels."""
    bottom, group = reconciled(t, a)
    models = {"bottom_up": bottom, "middle_out": B.middle_out(bottom, group, "item_id")}
    return rounded(M.model_metrics(M.score_models(t, a, models)), "wrmsse12", "wrmsse9", "rmsse_l12", "mase_l12", "bias")


on_cut_holdout("reconcile_eval", _reconcile_eval)
on_cut_holdout("level_bands", lambda t, a: M.model_levels(M.score_models(t, a, models_of(t, a))).filter("wrmsse is not null").select("model", "level", M.band(F.col("wrmsse")).alias("band")))
on_cut_holdout("level_heatmap", lambda t, a: rounded(M.model_levels(M.score_models(t, a, models_of(t, a))).filter("wrmsse is not null").select("model", "level", "wrmsse"), "wrmsse"))


def _segment(t: DataFrame, a: DataFrame) -> DataFrame:
    joined = lambda p: M.one_to_one(a, p).groupBy("cat_id", "state_id").agg(F.round(ratio(F.sum(F.abs(F.col("units") - F.col("pred"))), F.sum("units")), 3).alias("wape"))
    one, two = joined(B.moving_average(t, a)).withColumnRenamed("wape", "ma4"), joined(B.seasonal_naive(t, a)).withColumnRenamed("wape", "seasonal_naive")
    return one.join(two, ["cat_id", "state_id"], "full")


on_holdout("segment_wape", _segment)


def fold_scores(p: DataFrame) -> DataFrame:
    """WAPE of the models in four folds of eight weeks; the panel is made once."""
    rows = cut(S.with_back(p))
    out = None
    for k in range(4):
        a, t = rows.filter(F.col("back").between(8 * k + 1, 8 * k + 8)).drop("back"), rows.filter(F.col("back") > 8 * k + 8).drop("back")
        for name, pred in (("ma4", B.moving_average(t, a)), ("seasonal_naive", B.seasonal_naive(t, a))):
            one = M.one_to_one(a, pred).agg(ratio(F.sum(F.abs(F.col("units") - F.col("pred"))), F.sum("units")).alias("wape")).select(F.lit(4 - k).alias("fold"), F.lit(name).alias("model"), "wape")
            out = one if out is None else out.unionByName(one)
    return out


on_panel("cv_summary", lambda p: fold_scores(p).groupBy("model").agg(r4(F.avg("wape")).alias("mean"), r4(F.stddev_samp("wape")).alias("std")))
on_panel("window_summary", lambda p: fold_scores(p).groupBy("model").agg(r4(F.avg("wape")).alias("mean"), r4(F.stddev_pop("wape")).alias("std")))
on_panel("fold_significance", lambda p: fold_scores(p).groupBy("fold").pivot("model", ["ma4", "seasonal_naive"]).agg(F.first("wape")).withColumn("d", F.col("seasonal_naive") - F.col("ma4")).agg(
    F.count_if(F.col("d") < 0).alias("wins"), r4(F.avg("d")).alias("mean_delta"), r4(F.stddev_samp("d")).alias("std_delta")))
on_panel("folds", lambda p: ML.folds(S.ranked_weeks(p)))
on_runs("quantile_metrics", lambda p, r, q: rounded(M.quantile_metrics(last_run(q), p), *(f"{m}_{c}" for m in ("pinball", "cover") for c in ("p10", "p50", "p90")), "interval"))

# Runs and catalogue
on_runs("recent_runs", lambda p, r, q: R.recent_runs(r))
on_runs("active_runs", lambda p, r, q: R.active_runs(r.unionByName(r.withColumn("status", F.lit("queued")))))
on_runs("run_status_counts", lambda p, r, q: r.groupBy("status").count().withColumnRenamed("count", "n"))
on_runs("last_run_id", lambda p, r, q: r.groupBy("status").agg(F.max("run_id").alias("run_id")))
on_panel("chunk_plan", R.chunk_plan)
on_panel("chunk_state", lambda p: R.chunk_state(S.chunk_log(p)))
on_panel("run_status", lambda p: R.run_status(R.chunk_state(S.chunk_log(p))))
on_panel("run_progress", lambda p: R.run_progress(R.chunk_state(S.chunk_log(p))))
on_panel("stale_chunks", lambda p: R.stale_chunks(S.chunk_log(p), "2001-09-15 00:00:00"))
on_runs("catalog", lambda p, r, q: R.catalog(last_run(q), L.series_dim(p)))
on_runs("catalog_rollup", lambda p, r, q: R.catalog_rollup(R.catalog(last_run(q), L.series_dim(p))))
on_runs("width_bands", lambda p, r, q: R.width_bands(R.catalog(last_run(q), L.series_dim(p))))
on_panel("catalog_search", lambda p: R.select_series(L.series_dim(p), text="brand#1").select("id"))
on_panel("catalog_drill", lambda p: R.select_series(L.series_dim(p), state="EUROPE", dept="D1").select("id", "store_id"))
on_runs("agg_forecast", lambda p, r, q: R.agg_forecast(last_run(q), R.select_series(L.series_dim(p), state="EUROPE")))
on_runs("agg_history", lambda p, r, q: R.agg_history(p, R.select_series(L.series_dim(p), state="EUROPE"), last_run(q)))
on_runs("export_rows", lambda p, r, q: R.export_rows(last_run(q), L.series_dim(p)))
on_runs("upsert_points", lambda p, r, q: L.upsert(q.select("series_id", "week_start_date", "run_id", "p50"), last_run(q).select("series_id", "week_start_date", (F.col("run_id") + 1).alias("run_id"), (F.col("p50") + 1).alias("p50")), ["series_id", "week_start_date"], "run_id"))
on_runs("rearrange_quantiles", lambda p, r, q: B.rearrange(last_run(q).withColumns({"p10": F.col("p90"), "p90": F.col("p10")})))


def _fallback(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    t, _ = S.holdout(p)
    named = lambda df: df.withColumnRenamed("id", "series_id")
    wild = last_run(q).withColumn("p50", F.when((F.col("h") == 3) & F.col("series_id").like("%NATION_3"), F.lit(1e9)).otherwise(F.col("p50")))
    return B.apply_fallback(wild, named(B.last_rows_peak(t)), named(B.last_rows_level(t)))


on_runs("apply_fallback", _fallback)


def _series_forecast(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    """The last 40 full weeks and the forecast of the series of the most units (ties by id)."""
    best = p.groupBy("id").agg(F.sum("units").alias("u")).orderBy(F.desc("u"), "id").limit(1).select("id")
    past = p.filter("n_days = 7").join(F.broadcast(best), "id").orderBy(F.desc("week_start_date")).limit(40)
    ahead = last_run(q).join(F.broadcast(best.withColumnRenamed("id", "series_id")), "series_id")
    return past.select("week_start_date", F.lit("history").alias("kind"), F.col("units").cast("double").alias("value")).unionByName(ahead.select("week_start_date", F.lit("forecast").alias("kind"), F.col("p50").alias("value")))


on_runs("series_forecast", _series_forecast)


def _chart(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    """Weekly totals: 30 weeks before the first forecast one as history, and actuals within the forecast weeks."""
    span = last_run(q).agg(F.min("week_start_date").alias("lo"), F.max("week_start_date").alias("hi"))
    total = p.filter("n_days = 7").groupBy("week_start_date").agg(F.sum("units").alias("units")).crossJoin(F.broadcast(span))
    before = total.filter("week_start_date < lo").orderBy(F.desc("week_start_date")).limit(30).select("week_start_date", "units", F.lit("history").alias("kind"))
    return before.unionByName(total.filter("week_start_date between lo and hi").select("week_start_date", "units", F.lit("actual").alias("kind")))


on_runs("chart_context", _chart)

# Monitoring
on_runs("last_matured_run", lambda p, r, q: O.last_matured_run(q, p, r))
on_runs("accuracy_vs_actual", lambda p, r, q: O.accuracy(O.with_actuals(last_run(q), p)))
on_runs("acc_by_horizon", lambda p, r, q: O.accuracy_by(O.with_actuals(last_run(q), p), "h"))
on_runs("acc_by_state", lambda p, r, q: O.accuracy_by(O.with_actuals(last_run(q), p), "state_id"))
on_runs("acc_by_promo", lambda p, r, q: O.accuracy_by(O.promo_flag(O.with_actuals(last_run(q), p)), "promo"))


def half_run(q: DataFrame) -> DataFrame:
    """The last run as if it had been asked for the stores of nations with an even last digit only."""
    return last_run(q).filter(F.col("series_id").rlike("[02468]$"))


def _breakdowns(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    mine = cut(half_run(q))
    history = O.of_run(p, mine)
    matched = O.promo_flag(O.with_actuals(mine, history)).join(O.segments(history, S.origin_of(p)), "series_id", "left")
    return O.breakdowns(matched)


on_runs("acc_breakdowns", _breakdowns)
on_runs("run_segments", lambda p, r, q: O.segments(O.of_run(p, half_run(q)), S.origin_of(p)))
on_runs("run_drift_windows", lambda p, r, q: O.drift_windows(O.of_run(p, half_run(q)), S.origin_of(p)).groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units")))
on_panel("segments", lambda p: O.segments(p, S.origin_of(p)))
on_runs("acc_by_segment", lambda p, r, q: O.accuracy_by(O.with_actuals(last_run(q), p).join(O.segments(p, S.origin_of(p)), "series_id"), "segment"))
on_runs("fva_ma4", lambda p, r, q: O.fva(O.with_actuals(q.filter("run_id = 4"), p), S.with_back(p).filter("back >= 15")))
on_runs("fva_last_run", lambda p, r, q: O.fva(O.with_actuals(last_run(q), p), S.holdout(p)[0]))
on_runs("planning_bias", lambda p, r, q: O.planning_bias(O.accuracy_by(O.with_actuals(last_run(q), p), "state_id")))
on_panel("data_freshness", O.freshness)
on_panel("assortment_churn", O.churn)
on_runs("run_coverage", lambda p, r, q: O.run_coverage(q, r))
on_runs("revision_volatility", lambda p, r, q: O.revision_volatility(q, r))
on_panel("drift_windows", lambda p: O.drift_windows(p, S.origin_of(p)).groupBy("side", "id").agg(F.count(F.lit(1)).alias("n"), F.sum("units").alias("units"), r4(F.avg("sell_price")).alias("price")))
on_panel("drift_psi", lambda p: O.psi(O.drift_windows(p, S.origin_of(p)), "sell_price").unionByName(O.psi(O.drift_windows(p, S.origin_of(p)), "units")))
on_panel("drift_ks", lambda p: O.ks(O.drift_windows(p, S.origin_of(p)), "sell_price").unionByName(O.ks(O.drift_windows(p, S.origin_of(p)), "units")))


def on_cut_runs(name: str, f: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]) -> None:
    """For what reads panel, runs and points many times: each is made once."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        p = cut(S.panel(spark, sf))
        r = cut(S.runs(p))
        return f(p, r, cut(S.points(p, r)))

    QUERIES[name] = run


def report(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    """One row of all measures of the last run. Each part is one row."""
    m = cut(O.with_actuals(last_run(q), p))
    windows = cut(O.drift_windows(p, S.origin_of(p)))  # any feature's drift counts
    promo = O.accuracy_by(O.promo_flag(m), "promo").filter("promo").select(F.col("wmape").alias("promo_wmape"))
    parts = [
        O.accuracy(m).select("wmape", "bias", "coverage"), O.planning_bias(O.accuracy_by(m, "state_id")), O.freshness(p).select("completeness"),
        O.revision_volatility(q, r).select(F.col("volatility").alias("revision")), O.run_coverage(q, r).agg(F.min("coverage").alias("run_coverage")),
        O.fva(m, S.holdout(p)[0]).select(F.col("fva_pct").alias("fva")),
        *(test(windows, "sell_price").select(name).union(test(windows, "units").select(name)).agg(F.max(name).alias(name)) for name, test in (("psi", O.psi), ("ks", O.ks))),
    ]
    out = promo
    for part in parts:
        out = out.crossJoin(F.broadcast(part))  # one row each
    return out


on_cut_runs("gate", lambda p, r, q: O.gate(report(p, r, q)).select(F.concat_ws(",", "warnings").alias("warnings"), "degraded"))
on_cut_runs("gauges", lambda p, r, q: O.gauges(report(p, r, q)))
on_cut_runs("alerts", lambda p, r, q: O.alerts(O.gauges(report(p, r, q))).select("name", "firing"))
on_holdout("deploy_gate", lambda t, a: M.wrmsse(M.rmsse(t, a, B.moving_average(t, a))).select((F.col("wrmsse") <= O.DEPLOY_WRMSSE).alias("deploy")))


@query
def metriclog_latest(spark: SparkSession, sf: str) -> DataFrame:
    """The latest entry of each fold and model, of a log to which every run appends."""
    log = fold_scores(S.panel(spark, sf)).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("value", F.col("wape") + F.col("run"))
    return log.groupBy("fold", "model").agg(r4(F.max_by("value", "run")).alias("value"), F.max("run").alias("run"))


# Contracts
on_panel("contract_weekly", lambda p: C.violations(p, C.WEEKLY))
on_panel("contract_features", lambda p: C.violations(X.build_direct(p), C.FEATURES))
on_runs("contract_output", lambda p, r, q: C.violations(q, C.OUTPUT))
QUERIES["contract_calendar"] = lambda spark, sf: C.violations(L.calendar(S.calendar_days(spark, sf)), C.CALENDAR)
QUERIES["contract_prices"] = lambda spark, sf: C.violations(weekly_prices(spark, sf), C.PRICES)
on_panel("contract_members", lambda p: C.violations(p, C.members({}, state_id=STATES, dept_id=[f"D{k}" for k in range(5)], cat_id=["C0"])))

# Exploration
for _name, _f in {
    "eda_structure": E.structure, "eda_quality": E.quality, "eda_oos": E.oos, "eda_target": E.target, "eda_rolling": E.rolling_total, "eda_yoy": E.yoy, "eda_season": E.season,
    "eda_acf": E.acf, "eda_share": E.share, "eda_pareto": E.pareto, "sb_class": E.syntetos_boylan, "eda_snap": E.snap, "eda_event_lift": E.event_lift, "eda_corr": E.correlation,
    "eda_age": E.age, "eda_split": E.split, "eda_missing": E.missing, "eda_zero_share": E.zero_share, "availability_summary": E.availability,
}.items():
    on_panel(_name, _f)
on_panel("eda_pivot", lambda p: E.pivot(p, STATES))
on_panel("eda_pivot_revenue", lambda p: rounded(E.pivot(p, STATES, "revenue"), *STATES))
on_panel("eda_season_weeks", lambda p: E.season(p, "woy"))
on_panel("eda_corr_category", lambda p: E.correlation(p, "cat_id"))
on_panel("eda_corr_store", lambda p: E.correlation(p, "store_id"))
on_panel("eda_describe", lambda p: E.describe(p, ["units", "sell_price", "snap_days", "event_days", "available_days"]))
QUERIES["eda_named_events"] = lambda spark, sf: E.named_event_lift(S.panel(spark, sf), L.calendar(S.calendar_days(spark, sf)))
on_panel("eda_promo_lift", lambda p: E.promo_lift(X.prices(p)))
on_panel("top_series", lambda p: E.top_k(p, ["cat_id"], 1))
on_panel("panel_topk", lambda p: E.top_k(p, ["store_id", "dept_id"], 15))

on_panel("eda_lorenz", E.lorenz)
on_panel("eda_describe_text", lambda p: E.describe_text(p, ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]))
on_runs("labelled_gauges", lambda p, r, q: O.labelled(_breakdowns(p, r, q)))
on_panel("create_run", lambda p: R.create_run(R.select_series(L.series_dim(p), state="EUROPE"), 7, 20))
on_runs("fail_run", lambda p, r, q: R.fail_run(r.withColumn("status", F.when(F.col("run_id") > 3, F.lit("queued")).otherwise(F.col("status"))), r.filter("run_id % 2 = 0")).select("run_id", "status"))
on_runs("chart_payload", lambda p, r, q: R.payload(_chart(p, r, q), "units"))


@query
def snap_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.sales(spark, sf).select("state_id", F.col("day").alias("date")).distinct().join(S.calendar_days(spark, sf), "date")
    return L.snap_or_zero(rows, {"ASIA": "snap_a", "EUROPE": "snap_b", "AFRICA": "snap_c"}).select("state_id", "date", "snap")


def _stale(p: DataFrame, r: DataFrame, q: DataFrame) -> DataFrame:
    """The gate over a run that forecasts double, by a model 20 days old: rules that a good run never meets."""
    double = cut(q.withColumns({c: 2 * F.col(c) for c in ("p10", "p50", "p90")}))
    return O.gate(report(p, r, double).withColumn("artifact_age", F.lit(20.0))).select(F.concat_ws(",", "warnings").alias("warnings"), "degraded")


on_cut_runs("gate_stale", _stale)


def _broken(p: DataFrame) -> DataFrame:
    """The weekly contract over a panel in which some weeks of the year are broken, each in its own way."""
    woy = F.weekofyear("week_start_date")
    bad = lambda k, c, v: F.when(woy % k == 0, v).otherwise(F.col(c))
    rows = p.withColumns({
        "units": bad(7, "units", F.lit(-1)), "revenue": bad(9, "revenue", F.lit(-0.5)), "sell_price": bad(11, "sell_price", F.lit(0.0)), "snap_days": bad(13, "snap_days", F.lit(8)),
        "event_days": bad(15, "event_days", F.lit(15)), "available_days": bad(17, "available_days", F.lit(-1)), "n_days": bad(19, "n_days", F.lit(0)), "id": bad(21, "id", F.lit(None).cast("string")),
    })
    return C.violations(rows, C.members(C.WEEKLY, state_id=["ASIA", "EUROPE"]))


on_panel("contract_broken", _broken)


def _broken_features(p: DataFrame) -> DataFrame:
    """The features' contract over a panel with units, snap days and categories broken in some weeks of the year."""
    woy = F.weekofyear("week_start_date")
    rows = p.withColumns({"units": F.when(woy == 7, -1000000).otherwise(F.col("units")), "snap_days": F.when(woy == 13, 8).otherwise(F.col("snap_days")), "cat_id": F.when(woy != 20, F.col("cat_id"))})
    return C.violations(ML.boost_frame(rows), C.BOOST)


on_panel("contract_boost_features", _broken_features)

# Models and streams, which SQL has no words for
on_panel("cold_split", lambda p: ML.cold_split(p, 20).groupBy("item_id", "cold").agg(F.count(F.lit(1)).alias("n")))


def _fit(p: DataFrame) -> tuple[object, DataFrame]:
    """A model of the 104 weeks before the calibration weeks, and the frame that it reads, made once for all passes of the fit."""
    frame = ML.prepare(S.with_back(X.build_direct(p)).filter("back <= 16 + 104"))
    used = ["id", "dept_id", "week_start_date", "units", "available_days", "back", "lag_1", "label", "weight", *ML.NUMERIC]
    frame = cut(frame.select(*used))
    return ML.fit_tweedie(frame.filter("back > 16 and available_days > 0 and lag_1 is not null")), frame


def _serve(model: object, frame: DataFrame, rows: DataFrame, train: DataFrame) -> DataFrame:
    """The serving score of rows: calibrated forecasts with intervals, and the moving average for series that run away."""
    calibration = ML.predict(model, frame.filter("back between 9 and 16 and back = 17 - h"))
    points = ML.interval(B.calibrated(ML.predict(model, rows), calibration), B.calibrated(calibration, calibration)).withColumn("run_id", F.lit(1).cast("long"))
    named = lambda df: df.withColumnRenamed("id", "series_id")
    return B.apply_fallback(points, named(B.last_rows_peak(train)), named(B.last_rows_level(train))).drop("run_id", "bad")


def _score(p: DataFrame) -> DataFrame:
    model, frame = _fit(p)
    return _serve(model, frame, frame.filter("back <= 8 and back = 9 - h"), S.holdout(p)[0])


@query
def score_future(spark: SparkSession, sf: str) -> DataFrame:
    """Forecasts of the weeks after the history, from rows that only the calendar knows."""
    p = cut(S.panel(spark, sf))
    t, _ = S.holdout(p)
    model, frame = _fit(p)
    recent = S.with_back(p).filter("back between 9 and 9 + 60").drop("back")  # the longest feature looks 52 weeks back
    return _serve(model, frame, ML.prepare(X.future_frame(recent, future_with_calendar(spark, sf, t))), t)


@query
def importance(spark: SparkSession, sf: str) -> DataFrame:
    model, frame = _fit(cut(S.panel(spark, sf)))
    return ML.importance(model, frame.filter("back between 9 and 16"))


QUERIES["score"] = lambda spark, sf: _score(cut(S.panel(spark, sf)))


def _decompose(p: DataFrame) -> DataFrame:
    model, frame = _fit(p)
    return ML.decompose(model.transform, frame.filter("back <= 8 and back = 9 - h"))


QUERIES["decompose"] = lambda spark, sf: _decompose(cut(S.panel(spark, sf)))


@query
def structural_ratio(spark: SparkSession, sf: str) -> DataFrame:
    t, a = S.holdout(S.panel(spark, sf))
    model = ML.fit_fourier(B.group_ratio(t, B.ma_level(t)).filter("ratio > 0"))
    weeks = ML.fourier(a.select("week_start_date").distinct())
    return model.transform(weeks).select("week_start_date", F.exp("prediction").alias("ratio"))


def score_stream(spark: SparkSession, sf: str) -> DataFrame:
    t, a = S.holdout(S.panel(spark, sf))
    chunks = B.moving_average(t, a).select(F.col("id").alias("series_id"), "week_start_date", "pred")
    return stream_score(spark, chunks, lambda batch: batch.select("series_id", "week_start_date", (0.5 * F.col("pred")).alias("p10"), F.col("pred").alias("p50"), (1.5 * F.col("pred")).alias("p90")))


QUERIES["stream_score"] = score_stream


@query
def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of counters of events by type, which start anew each day."""
    events = S.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    day = Window.partitionBy("event_type", F.to_date("ts")).orderBy("ts", "event_id")
    rates = counter_rate(events.select(F.col("event_type").alias("key"), "ts", F.row_number().over(day).cast("double").alias("value")), 120, 60)
    return rounded(rates, "increase").withColumn("per_second", F.round("per_second", 8))


QUERIES["sustained_alerts"] = lambda spark, sf: sustained_events(spark, sf, F.col("value") > 5, F.col("event_type"), 60, 30)
QUERIES["stream_rate"] = stream_rate
QUERIES["hist_quantile"] = lambda spark, sf: hist_quantile(S.table(spark, sf, "events"), "value", (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0), 0.95)
