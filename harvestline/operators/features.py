"""Leak-free features by series: all frames share one window, so a frame costs one exchange and one sort."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from harvestline.functions import clip, flag, ratio, week_number

LAGS = (1, 2, 3, 4, 8, 13, 26, 52)
MEANS = (4, 8, 13, 26)
HORIZON = 8


def series() -> WindowSpec:
    return Window.partitionBy("id").orderBy("week_start_date")


def lags(panel: DataFrame, h: int = 1, ks: tuple[int, ...] = LAGS) -> DataFrame:
    """lag_k for horizon h: units h - 1 + k rows back."""
    return panel.withColumns({f"lag_{k}": F.lag("units", h - 1 + k).over(series()) for k in ks})


def rolling(panel: DataFrame, h: int = 1, means: tuple[int, ...] = MEANS, std: int = 13) -> DataFrame:
    frame = lambda m: series().rowsBetween(-(h + m - 1), -h)
    return panel.withColumns(
        {f"rmean_{m}": F.avg("units").over(frame(m)) for m in means}
        | {f"rstd_{std}": F.stddev_samp("units").over(frame(std)), f"rmax_{std}": F.max("units").over(frame(std))}
    )


def nonzero_shares(panel: DataFrame, h: int = 1, ms: tuple[int, ...] = (4, 13)) -> DataFrame:
    sold = F.when(F.col("units").isNotNull(), (F.col("units") > 0).cast("double"))
    return panel.withColumns({f"nz_share_{m}": F.avg(sold).over(series().rowsBetween(-(h + m - 1), -h)) for m in ms})


def cross_series(panel: DataFrame, h: int = 1) -> DataFrame:
    """Mean over the series' own last four rows of its item's and its department's weekly units."""
    total = lambda key: F.sum("units").over(Window.partitionBy(key, "week_start_date"))
    frame = series().rowsBetween(-(h + 3), -h)
    wide = panel.withColumns({"item_units": total("item_id"), "dept_units": total("dept_id")})
    return wide.withColumns({"item_rmean_4": F.avg("item_units").over(frame), "dept_rmean_4": F.avg("dept_units").over(frame)})


def prices(panel: DataFrame, promo: float = 0.9) -> DataFrame:
    """Price against the median of the 52 rows before (8 known ones at least), promotion flag, weeks since the last promotion."""
    before = series().rowsBetween(-52, -1)
    median = F.when(F.count("sell_price").over(before) >= 8, F.percentile("sell_price", F.lit(0.5)).over(before))
    out = panel.withColumn("price_median", median).withColumn("price_rel", ratio(F.col("sell_price"), F.col("price_median")))
    out = out.withColumn("is_promo", flag(F.col("price_rel") < promo)).withColumn("week_no", week_number(F.col("week_start_date")))
    last = F.last(F.when(F.col("is_promo") == 1, F.col("week_no")), ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("weeks_since_promo", F.coalesce(clip(F.col("week_no") - last, 0, 52), F.lit(52)).cast("int"))


def calendar_features(panel: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Week of year, its sine and cosine, month, end of year, weeks since the first sale (of rows up to as_of, if given)."""
    woy = F.weekofyear("week_start_date")
    sold = F.col("units") > 0 if as_of is None else (F.col("units") > 0) & (F.col("week_start_date") <= as_of)
    first = F.min(F.when(sold, F.col("week_start_date"))).over(Window.partitionBy("id"))
    age = F.floor(F.date_diff("week_start_date", first) / 7).cast("int")
    return panel.withColumns({
        "woy": woy, "woy_sin": F.sin(2 * math.pi * woy / 52), "woy_cos": F.cos(2 * math.pi * woy / 52), "month": F.month("week_start_date"),
        "is_year_end": flag(woy.isin(51, 52, 1)), "age_weeks": F.coalesce(F.greatest(age, F.lit(0)), F.lit(0)),
    })


def build_direct(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(id, week, h) frame: what is known h weeks before the week, one struct a row, looked back at h times.

    Equal to shifting each feature by h, with one exchange, one sort and no union.
    """
    back = lambda m: series().rowsBetween(-(m - 1), 0)
    sold = (F.col("units") > 0).cast("double")
    at_origin = F.struct(
        *(F.lag("units", k - 1).over(series()).alias(f"lag_{k}") for k in LAGS),
        *(F.avg("units").over(back(m)).alias(f"rmean_{m}") for m in MEANS),
        F.stddev_samp("units").over(back(13)).alias("rstd_13"), F.max("units").over(back(13)).alias("rmax_13"),
        *(F.avg(sold).over(back(m)).alias(f"nz_share_{m}") for m in (4, 13)),
        F.avg("item_units").over(back(4)).alias("item_rmean_4"), F.avg("dept_units").over(back(4)).alias("dept_rmean_4"),
    )
    total = lambda key: F.sum("units").over(Window.partitionBy(key, "week_start_date"))
    wide = panel.withColumns({"item_units": total("item_id"), "dept_units": total("dept_id")}).withColumn("known", at_origin)
    wide = wide.withColumn("seen", F.array(*(F.struct(F.lit(h).alias("h"), F.lag("known", h).over(series()).alias("f")) for h in range(1, horizon + 1))))
    keep = [c for c in panel.columns]
    return wide.select(*keep, F.inline("seen")).select(*keep, "h", "f.*")


def train_slice(frame: DataFrame, origin: Column, cap_weeks: int) -> DataFrame:
    week = F.col("week_start_date")
    return frame.filter((week <= origin) & (week > F.date_sub(origin, 7 * cap_weeks)) & (F.col("available_days") > 0))


def select_test(frame: DataFrame, origin: Column) -> DataFrame:
    """The row of the h-th week after the origin that was made for horizon h."""
    return frame.filter(F.col("week_start_date") == F.expr("date_add(origin, 7 * h)") if origin is None else F.date_diff("week_start_date", origin) == 7 * F.col("h"))


def future_frame(history: DataFrame, future: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """The features of future rows, each as they are known h weeks before: history and future rows are one frame for the windows."""
    both = history.unionByName(future.withColumnRenamed("h", "ahead"), allowMissingColumns=True)
    return build_direct(both, horizon).filter("ahead = h").drop("ahead")


def position(p: DataFrame) -> DataFrame:
    """Rows of the series before each row."""
    return p.withColumn("position", F.row_number().over(Window.partitionBy("id").orderBy("week_start_date")) - 1)
