"""Hierarchical scaled error metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestline.functions import ratio
from harvestline.sources.shared import cut

#: Grouping keys of the twelve levels; fixed by the metric's definition.
LEVELS = {
    1: [], 2: ["state_id"], 3: ["store_id"], 4: ["cat_id"], 5: ["dept_id"], 6: ["state_id", "cat_id"], 7: ["state_id", "dept_id"],
    8: ["store_id", "cat_id"], 9: ["store_id", "dept_id"], 10: ["item_id"], 11: ["item_id", "state_id"], 12: ["id"],
}
#: Levels that stay distinct where there is one category.
UNIQUE = (1, 2, 3, 5, 7, 9, 10, 11, 12)


def by_level(rows: DataFrame, levels: dict[int, list[str]] = LEVELS) -> DataFrame:
    """Each row once for each level with the level's series key; group by (level, sid, ...) right after, which sums before the shuffle."""
    sid = lambda keys: F.concat_ws("|", *keys) if keys else F.lit("TOTAL")
    return rows.withColumn("at", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), sid(v).alias("sid")) for k, v in levels.items())))).select("*", "at.*").drop("at")


def level_agg(rows: DataFrame, levels: dict[int, list[str]] = LEVELS) -> DataFrame:
    return by_level(rows, levels).groupBy("level", "sid", "week_start_date").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def naive_scale(level_rows: DataFrame) -> DataFrame:
    """Mean squared and absolute first difference of each series, where it is above 0."""
    step = F.col("units") - F.lag("units").over(Window.partitionBy("level", "sid").orderBy("week_start_date"))
    return level_rows.withColumn("step", step.cast("double")).groupBy("level", "sid").agg(F.avg(F.col("step") * F.col("step")).alias("scale"), F.avg(F.abs("step")).alias("abs_scale")).filter("scale > 0")


def level_weights(level_rows: DataFrame, k: int = 4) -> DataFrame:
    """Shares of the revenue of the last k weeks of the frame."""
    weeks = level_rows.select("week_start_date").distinct().orderBy(F.desc("week_start_date")).limit(k)
    recent = level_rows.join(F.broadcast(weeks), "week_start_date", "left_semi").groupBy("level", "sid").agg(F.sum("revenue").alias("revenue"))
    total = F.sum("revenue").over(Window.partitionBy("level"))
    return recent.withColumn("weight", ratio(F.col("revenue"), total)).drop("revenue")


def one_to_one(actual: DataFrame, pred: DataFrame) -> DataFrame:
    """actual with pred (0 where missing); a key that pred has twice fails the job."""
    once = pred.groupBy("id", "week_start_date").agg(F.count(F.lit(1)).alias("n"), F.first("pred").alias("pred"))
    once = once.withColumn("bad", F.assert_true(F.col("n") == 1, "a key is twice in the predictions")).filter(F.col("bad").isNull()).drop("bad", "n")
    return actual.join(once, ["id", "week_start_date"], "left").withColumn("pred", F.coalesce("pred", F.lit(0.0)))


def rmsse(train: DataFrame, actual: DataFrame, pred: DataFrame, levels: dict[int, list[str]] = LEVELS) -> DataFrame:
    """level, sid, rmsse, mase, weight. Actual and predicted units of a level come from one aggregate, so no level join is needed."""
    history = level_agg(train, levels)
    both = by_level(one_to_one(actual, pred), levels).groupBy("level", "sid", "week_start_date").agg(F.sum("units").alias("units"), F.sum("pred").alias("pred"))
    error = both.withColumn("e", F.col("units") - F.col("pred")).groupBy("level", "sid").agg(F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg(F.abs("e")).alias("mae"))
    joined = error.join(naive_scale(history), ["level", "sid"]).join(level_weights(history), ["level", "sid"])
    return joined.select("level", "sid", F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"), (F.col("mae") / F.nullif("abs_scale", F.lit(0.0))).alias("mase"), "weight")


def wrmsse_by_level(scores: DataFrame) -> DataFrame:
    """Weighted mean of each level that has weights."""
    out = scores.groupBy("level").agg(F.sum(F.col("weight") * F.col("rmsse")).alias("s"), F.sum("weight").alias("w"))
    return out.filter("w > 0").select("level", (F.col("s") / F.col("w")).alias("wrmsse"))


def wrmsse(scores: DataFrame, levels: tuple[int, ...] | None = None) -> DataFrame:
    by = wrmsse_by_level(scores)
    return (by if levels is None else by.filter(F.col("level").isin(*levels))).agg(F.avg("wrmsse").alias("wrmsse"))


def bias(actual: DataFrame, pred: DataFrame) -> DataFrame:
    total = one_to_one(actual, pred).agg(F.sum("units").alias("a"), F.sum("pred").alias("p"))
    return total.select(F.when(F.col("a") > 0, (F.col("p") - F.col("a")) / F.col("a")).alias("bias"))


def score_models(train: DataFrame, actual: DataFrame, models: dict[str, DataFrame], levels: dict[int, list[str]] = LEVELS) -> DataFrame:
    """model, level, sid, rmsse, mase, weight, units, pred of all models: scale and weights are made once, errors by one aggregate.

    Predictions are columns of the actual rows, 0 where a model has none; a key that a model has twice fails the job.
    """
    names = list(models)
    preds = None
    for name, pred in models.items():
        one = pred.select("id", "week_start_date", F.lit(name).alias("model"), "pred")
        preds = one if preds is None else preds.unionByName(one)
    most = F.greatest(*(F.count_if(F.col("model") == name) for name in names), F.lit(0))
    wide = preds.groupBy("id", "week_start_date").agg(most.alias("most"), *(F.max(F.when(F.col("model") == name, F.col("pred"))).alias(f"pred_{k}") for k, name in enumerate(names)))
    wide = wide.withColumn("bad", F.assert_true(F.col("most") <= 1, "a key is twice in the predictions")).filter(F.col("bad").isNull()).drop("bad", "most")
    rows = actual.join(wide, ["id", "week_start_date"], "left").fillna(0.0, [f"pred_{k}" for k in range(len(names))])
    both = by_level(rows, levels).groupBy("level", "sid", "week_start_date").agg(F.sum("units").alias("units"), *(F.sum(f"pred_{k}").alias(f"pred_{k}") for k in range(len(names))))
    each = both.select("level", "sid", "units", F.explode(F.array(*(F.struct(F.lit(name).alias("model"), F.col(f"pred_{k}").alias("pred")) for k, name in enumerate(names)))).alias("m")).select("level", "sid", "units", "m.*")
    e = F.col("units") - F.col("pred")
    error = each.groupBy("model", "level", "sid").agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.sum("units").alias("units"), F.sum("pred").alias("pred"))
    history = cut(level_agg(train, levels))
    base = naive_scale(history).join(level_weights(history), ["level", "sid"])
    joined = error.join(base, ["level", "sid"], "left")
    return joined.select("model", "level", "sid", F.sqrt(F.col("mse") / F.col("scale")).alias("rmsse"), (F.col("mae") / F.nullif("abs_scale", F.lit(0.0))).alias("mase"), "weight", "units", "pred")


def model_levels(scores: DataFrame) -> DataFrame:
    """model, level, wrmsse and the unweighted means, bias of each level of the scores; levels without weights have no wrmsse."""
    known = F.col("rmsse").isNotNull() & F.col("weight").isNotNull()
    total = F.sum(F.when(known, F.col("weight")))
    return scores.groupBy("model", "level").agg(
        F.when(total > 0, F.sum(F.when(known, F.col("weight") * F.col("rmsse"))) / total).alias("wrmsse"), F.avg("rmsse").alias("rmsse"), F.avg("mase").alias("mase"),
        F.when(F.sum("units") > 0, (F.sum("pred") - F.sum("units")) / F.sum("units")).alias("bias"),
    )


def model_metrics(scores: DataFrame) -> DataFrame:
    """One row for each model: WRMSSE of 12 and 9 levels, unweighted RMSSE and MASE of the lowest level, bias."""
    low = lambda c: F.max(F.when(F.col("level") == 12, F.col(c)))
    return model_levels(scores).groupBy("model").agg(
        F.avg("wrmsse").alias("wrmsse12"), F.avg(F.when(F.col("level").isin(*UNIQUE), F.col("wrmsse"))).alias("wrmsse9"), low("rmsse").alias("rmsse_l12"), low("mase").alias("mase_l12"),
        F.max(F.when(F.col("level") == 1, F.col("bias"))).alias("bias"),
    )


def all_metrics(train: DataFrame, actual: DataFrame, pred: DataFrame) -> DataFrame:
    """One row: WRMSSE of 12 and 9 levels, unweighted RMSSE and MASE of the lowest level, bias."""
    scores = rmsse(train, actual, pred)
    low = scores.filter("level = 12").agg(F.avg("rmsse").alias("rmsse_l12"), F.avg("mase").alias("mase_l12"))
    by = wrmsse_by_level(scores).agg(F.avg("wrmsse").alias("wrmsse12"), F.avg(F.when(F.col("level").isin(*UNIQUE), F.col("wrmsse"))).alias("wrmsse9"))
    return by.crossJoin(low).crossJoin(bias(actual, pred))  # one row each


def quantile_metrics(points: DataFrame, actual: DataFrame) -> DataFrame:
    """Pinball loss and coverage of each quantile, and of the interval."""
    a = actual.select(F.col("id").alias("series_id"), "week_start_date", "units")
    joined = points.join(a, ["series_id", "week_start_date"])
    pinball = lambda c, q: F.avg(F.greatest(q * (F.col("units") - F.col(c)), (q - 1) * (F.col("units") - F.col(c))))
    cover = lambda c: F.avg((F.col("units") <= F.col(c)).cast("double"))
    quantiles = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    return joined.agg(
        *(pinball(c, q).alias(f"pinball_{c}") for c, q in quantiles.items()), *(cover(c).alias(f"cover_{c}") for c in quantiles),
        F.avg(F.col("units").between(F.col("p10"), F.col("p90")).cast("double")).alias("interval"), F.lit(0.8).alias("interval_target"),
    )


def band(wrmsse: Column) -> Column:
    """good below 0.65, fair below 0.85, poor from there."""
    return F.when(wrmsse < 0.65, "good").when(wrmsse < 0.85, "fair").when(wrmsse.isNotNull(), "poor")
