"""Baseline forecasters and what is made of forecasts: masks, fallbacks, ensembles, reconciliation, future rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestline.functions import clip, ratio


def last_weeks(train: DataFrame, k: int) -> DataFrame:
    """Rows of the last k weeks of the whole frame."""
    weeks = train.select("week_start_date").distinct().orderBy(F.desc("week_start_date")).limit(k)
    return train.join(F.broadcast(weeks), "week_start_date", "left_semi")  # k rows


def ma_level(train: DataFrame, k: int = 4) -> DataFrame:
    return last_weeks(train, k).groupBy("id").agg(F.avg("units").alias("level"))


def last_rows_level(rows: DataFrame, k: int = 4) -> DataFrame:
    """Mean of each series' own last k rows."""
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("week_start_date")))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= k).groupBy("id").agg(F.avg("units").alias("level"))


def last_rows_peak(rows: DataFrame, k: int = 13) -> DataFrame:
    """The most units of each series' own last k rows, which spares promotions' peaks."""
    rn = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("week_start_date")))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= k).groupBy("id").agg(F.max("units").cast("double").alias("scale"))


def moving_average(train: DataFrame, test: DataFrame, k: int = 4) -> DataFrame:
    return test.join(ma_level(train, k), "id", "left").select("id", "week_start_date", F.coalesce("level", F.lit(0.0)).alias("pred"))


def seasonal_naive(train: DataFrame, test: DataFrame) -> DataFrame:
    """Units 364 days before; without them the moving average."""
    ago = train.select("id", F.date_add("week_start_date", 364).alias("week_start_date"), F.col("units").cast("double").alias("ago"))
    joined = test.join(ago, ["id", "week_start_date"], "left").join(ma_level(train), "id", "left")
    return joined.select("id", "week_start_date", F.coalesce("ago", "level", F.lit(0.0)).alias("pred"))


def seasonal_ma(train: DataFrame, test: DataFrame) -> DataFrame:
    """Moving average times the series' index of the week of the year, within [0, 5]; 1 where it has none."""
    woy = train.withColumn("woy", F.weekofyear("week_start_date"))
    index = woy.groupBy("id", "woy").agg(F.avg("units").alias("by_woy")).join(train.groupBy("id").agg(F.avg("units").alias("all")), "id")
    index = index.select("id", "woy", clip(ratio(F.col("by_woy"), F.col("all")), 0.0, 5.0).alias("idx"))
    joined = test.withColumn("woy", F.weekofyear("week_start_date")).join(index, ["id", "woy"], "left").join(ma_level(train), "id", "left")
    return joined.select("id", "week_start_date", (F.coalesce("level", F.lit(0.0)) * F.coalesce("idx", F.lit(1.0))).alias("pred"))


def croston(train: DataFrame, alpha: float = 0.1) -> DataFrame:
    """Croston's rate with the Syntetos-Boylan correction, in closed form: weights of a geometric smoother over the non-zero weeks."""
    by_week = Window.partitionBy("id").orderBy("week_start_date")
    rows = train.withColumn("pos", F.row_number().over(by_week)).filter("units > 0")
    rows = rows.withColumn("gap", F.col("pos") - F.coalesce(F.lag("pos").over(by_week), F.lit(0)))
    i, n = F.row_number().over(by_week), F.count(F.lit(1)).over(Window.partitionBy("id"))
    rows = rows.withColumns({"i": i, "n": n})
    weight = F.when(F.col("i") == 1, F.pow(F.lit(1 - alpha), F.col("n") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("n") - F.col("i")))
    rates = rows.groupBy("id").agg((F.sum(weight * F.col("units")) / F.sum(weight * F.col("gap")) * (1 - alpha / 2)).alias("rate"))
    return train.select("id").distinct().join(rates, "id", "left").select("id", F.coalesce("rate", F.lit(0.0)).alias("rate"))


def imapa(train: DataFrame, alphas: tuple[float, ...] = (0.1, 0.15, 0.2, 0.25, 0.3), most: int | None = None) -> DataFrame:
    """id, rate, levels: the mean over aggregation levels of what simple exponential smoothing expects of a week.

    Level k sums the series' last weeks by k (the first weeks that fill no sum are left out), smooths the sums with the alpha of the
    least squared one-step error (of equals the smallest) and divides by k. There are as many levels as the mean gap between
    sales, rounded half to even, and at most as many as asked for; a series without sales has rate 0. A series' weeks are one array.
    """
    weeks = train.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("week_start_date", "units"))).alias("w"))
    y = F.transform("w", lambda x: x["units"].cast("double"))
    last = F.array_max(F.transform(F.sequence(F.lit(1), F.size("y")), lambda i: F.when(F.element_at("y", i) > 0, i)))
    n = F.size(F.filter("y", lambda x: x > 0))
    levels = F.bround(last / n, 0).cast("int")
    rows = weeks.select("id", y.alias("y")).withColumn("levels", F.when(n > 0, levels if most is None else F.least(levels, F.lit(most))).otherwise(0))
    rows = rows.withColumn("k", F.explode_outer(F.when(F.col("levels") > 0, F.sequence(F.lit(1), F.col("levels")))))
    size = F.floor(F.size("y") / F.col("k")).cast("int")
    part = lambda i: F.slice("y", F.size("y") - (size - i) * F.col("k") + 1, F.col("k"))
    sums = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.aggregate(part(i), F.lit(0.0), lambda a, x: a + x))
    rows = rows.withColumn("sums", F.when(F.col("k").isNotNull(), sums))

    def smooth(alpha: float):
        start = F.struct(F.element_at("sums", 1).alias("level"), F.lit(0.0).alias("error"))
        step = lambda a, x: F.struct((alpha * x + (1 - alpha) * a["level"]).alias("level"), (a["error"] + (x - a["level"]) * (x - a["level"])).alias("error"))
        done = F.aggregate(F.slice("sums", 2, F.size("sums")), start, step)
        return F.struct(done["error"].alias("error"), F.lit(alpha).alias("alpha"), done["level"].alias("level"))

    best = F.array_min(F.array(*map(smooth, alphas)))["level"]
    expected = rows.withColumn("each", F.when(F.col("k").isNotNull(), best / F.col("k")))
    return expected.groupBy("id").agg(F.coalesce(F.avg("each"), F.lit(0.0)).alias("rate"), F.max("levels").alias("levels"))


def ensemble(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("id", "week_start_date", F.col("pred").alias("other"))
    return a.join(b, ["id", "week_start_date"]).select("id", "week_start_date", ((F.col("pred") + F.col("other")) / 2).alias("pred"))


def mask_unavailable(pred: DataFrame, panel: DataFrame) -> DataFrame:
    days = panel.select("id", "week_start_date", "available_days")
    return pred.join(days, ["id", "week_start_date"], "left").withColumn("pred", F.when(F.col("available_days") == 0, 0.0).otherwise(F.greatest("pred", F.lit(0.0)))).drop("available_days")


def hybrid(model: DataFrame, level: DataFrame, train: DataFrame, least: float = 0.5) -> DataFrame:
    """The level for series that sold in less than that share of weeks, the model for the others."""
    share = train.groupBy("id").agg(F.avg((F.col("units") > 0).cast("double")).alias("share"))
    level = level.select("id", "week_start_date", F.col("pred").alias("ma"))
    joined = model.join(share, "id", "left").join(level, ["id", "week_start_date"], "left")
    return joined.select("id", "week_start_date", F.when(F.col("share") < least, F.col("ma")).otherwise(F.col("pred")).alias("pred"))


def apply_fallback(points: DataFrame, scale: DataFrame, level: DataFrame, factor: float = 10.0) -> DataFrame:
    """A series with any p50 that is missing, infinite or over factor times its scale gets its level, with p10 and p90 around it."""
    p50 = F.col("p50")
    bad = p50.isNull() | F.isnan(p50) | (F.abs(p50) == float("inf")) | (p50 > factor * F.greatest("scale", F.lit(1.0)))
    joined = points.join(scale, "series_id", "left").join(level, "series_id", "left")
    joined = joined.withColumn("bad", F.max(F.coalesce(bad, F.lit(False))).over(Window.partitionBy("run_id", "series_id")))
    swap = lambda name, k: F.when(F.col("bad"), k * F.coalesce("level", F.lit(0.0))).otherwise(F.col(name)).alias(name)
    return joined.select("run_id", "series_id", "week_start_date", "h", swap("p10", 0.5), swap("p50", 1.0), swap("p90", 1.5), "bad")


def rearrange(points: DataFrame) -> DataFrame:
    """Quantiles in order, whatever the models said."""
    q = F.array_sort(F.array("p10", "p50", "p90"))
    return points.withColumn("q", q).select("run_id", "series_id", "week_start_date", "h", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


def future_rows(history: DataFrame, horizon: int, assume_available: bool = False) -> DataFrame:
    """Rows of the weeks after the last one of the whole history: price and availability of each series' last row, units unknown.

    A series whose last row is older than that has the same weeks as the others.
    """
    last = history.groupBy("id", "item_id", "dept_id", "cat_id", "store_id", "state_id").agg(
        F.max_by("sell_price", "week_start_date").alias("sell_price"), F.max_by("available_days", "week_start_date").alias("available_days"),
    )
    last = last.crossJoin(F.broadcast(history.agg(F.max("week_start_date").alias("origin"))))  # one row
    out = last.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("week_start_date", F.expr("date_add(origin, 7 * h)"))
    days = F.lit(7) if assume_available else F.col("available_days")
    return out.withColumns({"units": F.lit(None).cast("long"), "revenue": F.lit(0.0), "n_days": F.lit(7), "available_days": days.cast("int")})


def with_calendar(future: DataFrame, weeks: DataFrame, snap: dict[str, str], other: str) -> DataFrame:
    """Future rows with event_days and their own state's snap_days of a weekly calendar; 0 in weeks that it lacks.

    snap names the calendar's column of a state, other that of all other states.
    """
    columns = sorted({*snap.values(), other})
    pick = F.col(other)
    for state, column in snap.items():
        pick = F.when(F.col("state_id") == state, F.col(column)).otherwise(pick)
    joined = future.join(F.broadcast(weeks.select("week_start_date", "event_days", *columns)), "week_start_date", "left")  # one row a week
    day_count = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return joined.withColumns({"snap_days": day_count(pick), "event_days": day_count(F.col("event_days"))}).drop(*columns)


def group_forecast(train: DataFrame, weeks: DataFrame, group: str, k: int = 4) -> DataFrame:
    """Moving average of a group's weekly sums, the same for each coming week."""
    total = last_weeks(train, k).groupBy(group, "week_start_date").agg(F.sum("units").alias("units"))
    level = total.groupBy(group).agg(F.avg("units").alias("agg_pred"))
    return level.crossJoin(F.broadcast(weeks.select("week_start_date").distinct()))  # a few weeks


def middle_out(bottom: DataFrame, group: DataFrame, key: str) -> DataFrame:
    """Bottom forecasts scaled to their group's; groups without any forecast share equally."""
    total = F.sum("pred").over(Window.partitionBy(key, "week_start_date"))
    n = F.count(F.lit(1)).over(Window.partitionBy(key, "week_start_date"))
    joined = bottom.withColumns({"total": total, "n": n}).join(group, [key, "week_start_date"], "left")
    share = F.when(F.col("total") > 0, F.col("pred") / F.col("total")).otherwise(1 / F.col("n"))
    return joined.select("id", key, "week_start_date", F.coalesce(F.col("agg_pred") * share, F.col("pred")).alias("pred"))


def reconciled_gap(bottom: DataFrame, group: DataFrame, key: str) -> DataFrame:
    total = bottom.groupBy(key, "week_start_date").agg(F.sum("pred").alias("total")).join(group, [key, "week_start_date"])
    return total.filter("total > 1e-9").agg(F.max(F.abs(F.col("total") - F.col("agg_pred"))).alias("gap"))


def calibration_factor(pred: DataFrame, actual: DataFrame) -> DataFrame:
    a = actual.select("id", "week_start_date", "units")
    return pred.join(a, ["id", "week_start_date"]).agg((F.sum("units") / F.greatest(F.sum("pred"), F.lit(1e-9))).alias("factor"))


def calibrated(pred: DataFrame, calibration: DataFrame) -> DataFrame:
    """Forecasts (pred) times actual over forecast units of the calibration rows (units, pred), one factor for all."""
    factor = calibration.agg((F.sum("units") / F.greatest(F.sum("pred"), F.lit(1e-9))).alias("factor"))
    return pred.crossJoin(F.broadcast(factor)).withColumn("pred", F.col("pred") * F.coalesce("factor", F.lit(1.0))).drop("factor")  # one row


def seasonal_decompose(train: DataFrame, group: str = "dept_id", period: int = 52) -> DataFrame:
    """Multiplicative index by phase: units over a centred moving average with half weights at its ends, averaged and scaled to mean 1."""
    half = period // 2
    total = train.groupBy(group, "week_start_date").agg(F.sum("units").cast("double").alias("y"))
    order = Window.partitionBy(group).orderBy("week_start_date")
    inner, outer = order.rowsBetween(-(half - 1), half - 1), order.rowsBetween(-half, half)
    trend = F.when(F.count("y").over(outer) == period + 1, (F.sum("y").over(inner) + 0.5 * (F.lag("y", half).over(order) + F.lead("y", half).over(order))) / period)
    rows = total.withColumns({"trend": trend, "phase": F.pmod(F.row_number().over(order) - 1, F.lit(period)).cast("int")})
    phase = rows.filter("trend > 0").groupBy(group, "phase").agg(F.avg(F.col("y") / F.col("trend")).alias("raw"))
    return phase.withColumn("seasonal", F.col("raw") / F.avg("raw").over(Window.partitionBy(group))).drop("raw")


def dept_seasonal_ma(train: DataFrame, test: DataFrame, k: int = 8, group: str = "dept_id") -> DataFrame:
    """Moving average times the group's decomposed index of the week of the year, within [0, 3]; 1 where it has none."""
    order = Window.partitionBy(group).orderBy("week_start_date")
    weeks = train.select(group, "week_start_date").distinct().withColumn("phase", F.pmod(F.row_number().over(order) - 1, F.lit(52)).cast("int"))
    index = weeks.join(seasonal_decompose(train, group), [group, "phase"]).groupBy(group, F.weekofyear("week_start_date").alias("woy")).agg(F.avg("seasonal").alias("idx"))
    joined = test.withColumn("woy", F.weekofyear("week_start_date")).join(index, [group, "woy"], "left").join(ma_level(train, k), "id", "left")
    pred = F.coalesce("level", F.lit(0.0)) * clip(F.coalesce("idx", F.lit(1.0)), 0.0, 3.0)
    return joined.select("id", "week_start_date", F.greatest(pred, F.lit(0.0)).alias("pred"))


def group_ratio(train: DataFrame, level: DataFrame, key: str = "dept_id", low: float = 0.05, high: float = 20.0) -> DataFrame:
    """Units over the sum of their series' levels, by group and week."""
    joined = train.join(level, "id", "left").groupBy(key, "week_start_date").agg(F.sum("units").alias("units"), F.sum(F.coalesce("level", F.lit(0.0))).alias("base"))
    return joined.filter("base > 0").select(key, "week_start_date", clip(F.col("units") / F.col("base"), low, high).alias("ratio"))


def suspect_zeros(train: DataFrame, least: float = 0.5) -> DataFrame:
    """Fully available weeks without sales of series that usually sell."""
    share = F.avg((F.col("units") > 0).cast("double")).over(Window.partitionBy("id"))
    return train.withColumn("share", share).withColumn("suspect", (F.col("units") == 0) & (F.col("available_days") == 7) & (F.col("share") >= least))
