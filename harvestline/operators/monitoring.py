"""Monitoring of live forecasts: accuracy, breakdowns, drift, churn, freshness, stability, and the gate over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestline.functions import mean_of, r4, ratio
from harvestline.operators.baselines import last_rows_level

#: The gate's thresholds; fixed values.
LIMITS = {
    "wmape": 0.5, "bias": 0.2, "coverage": 0.6, "psi": 0.25, "ks": 0.2, "planning_bias": 0.15, "promo_wmape": 0.5,
    "fva": -8.0, "completeness": 0.9, "revision": 0.3, "run_coverage": 0.99, "artifact_age": 14.0,
}
DEPLOY_WRMSSE = 0.75


def last_matured_run(points: DataFrame, history: DataFrame, runs: DataFrame) -> DataFrame:
    """The latest completed run of which some week has come."""
    come = history.filter("n_days = 7").select("id", "week_start_date").withColumnRenamed("id", "series_id")
    done = runs.filter("status = 'completed'").select("run_id")
    return points.join(F.broadcast(done), "run_id").join(come, ["series_id", "week_start_date"], "left_semi").agg(F.max("run_id").alias("run_id"))


def with_actuals(points: DataFrame, history: DataFrame) -> DataFrame:
    """Points of weeks that have come in full."""
    a = history.filter("n_days = 7").select(F.col("id").alias("series_id"), "week_start_date", "units", "state_id", "snap_days", "event_days")
    return points.join(a, ["series_id", "week_start_date"])


def _accuracy() -> list[Column]:
    e = F.col("p50") - F.col("units")
    return [
        F.count(F.lit(1)).alias("n"), r4(ratio(F.sum(F.abs(e)), F.sum("units"))).alias("wmape"), r4(ratio(F.sum(e), F.sum("units"))).alias("bias"),
        r4(mean_of(F.col("units").between(F.col("p10"), F.col("p90")))).alias("coverage"),
    ]


def accuracy(matched: DataFrame) -> DataFrame:
    return matched.agg(*_accuracy()).filter("n > 0")


def accuracy_by(matched: DataFrame, key: str) -> DataFrame:
    """Accuracy of each group that sold anything."""
    return matched.groupBy(key).agg(*_accuracy(), F.sum("units").alias("total")).filter("total > 0").drop("total")


def of_run(history: DataFrame, points: DataFrame) -> DataFrame:
    """The history of the series that the points have, and no others."""
    return history.join(points.select(F.col("series_id").alias("id")).distinct(), "id", "left_semi")


def breakdowns(matched: DataFrame, keys: tuple[str, ...] = ("h", "state_id", "promo", "segment")) -> DataFrame:
    """by, key, n, wmape, bias, coverage of each group of each key that sold anything, all from one aggregate; rows whose key is null have none."""
    named = matched.select("p10", "p50", "p90", "units", *(F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys))
    sets = named.groupingSets([[F.col(k)] for k in keys], *keys).agg(*_accuracy(), F.sum("units").alias("total"))
    key = F.coalesce(*(F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("by"), F.col(k).alias("key"))) for k in keys))
    named = sets.filter("total > 0").select(key.alias("at"), "n", "wmape", "bias", "coverage")
    return named.filter(F.col("at.key") != "\0").select("at.*", "n", "wmape", "bias", "coverage")


def promo_flag(matched: DataFrame) -> DataFrame:
    return matched.withColumn("promo", (F.col("event_days") > 0) | (F.col("snap_days") > 0))


def segments(history: DataFrame, origin: DataFrame) -> DataFrame:
    """coldstart under 26 weeks of history, else intermittent under a mean of 1, else frequent; history up to the one-row origin."""
    past = history.filter("n_days = 7").crossJoin(F.broadcast(origin)).filter("week_start_date <= origin")
    stats = past.groupBy("id").agg(F.count(F.lit(1)).alias("n_weeks"), F.avg("units").alias("mu"))
    segment = F.when(F.col("n_weeks") < 26, "coldstart").when(F.col("mu") < 1, "intermittent").otherwise("frequent")
    return stats.select(F.col("id").alias("series_id"), segment.alias("segment"))


def fva(matched: DataFrame, past: DataFrame) -> DataFrame:
    """Per cent by which the model's WMAPE is below that of each series' own last four rows."""
    level = last_rows_level(past).select(F.col("id").alias("series_id"), "level")
    joined = matched.join(level, "series_id", "left").withColumn("ma", F.coalesce("level", F.lit(0.0)))
    w = lambda c: ratio(F.sum(F.abs(F.col(c) - F.col("units"))), F.sum("units"))
    return joined.agg(w("p50").alias("model"), w("ma").alias("ma4")).select(r4("model").alias("model"), r4("ma4").alias("ma4"), F.round(ratio(F.col("ma4") - F.col("model"), F.col("ma4")) * 100, 1).alias("fva_pct"))


def freshness(history: DataFrame) -> DataFrame:
    """Latest full week, number of weeks, share of the series of the last 13 weeks that the latest one has."""
    full = history.filter("n_days = 7")
    latest = full.agg(F.max("week_start_date").alias("latest"))
    rows = full.crossJoin(F.broadcast(latest))
    now = F.count_distinct(F.when(F.col("week_start_date") == F.col("latest"), F.col("id")))
    base = F.count_distinct(F.when(F.col("week_start_date") > F.date_sub("latest", 91), F.col("id")))
    return rows.agg(F.max("latest").alias("latest"), F.count_distinct("week_start_date").alias("n_weeks"), r4(ratio(now, base)).alias("completeness"))


def churn(history: DataFrame, weeks: int = 13) -> DataFrame:
    """New, dead and active series, by what sold in two windows side by side; one pass, one row a series."""
    sold = history.filter("n_days = 7 and units > 0")
    latest = history.filter("n_days = 7").agg(F.max("week_start_date").alias("latest"))
    rows = sold.crossJoin(F.broadcast(latest)).filter(F.col("week_start_date") > F.date_sub("latest", 14 * weeks))
    flags = rows.withColumn("recent", F.col("week_start_date") > F.date_sub("latest", 7 * weeks)).groupBy("id").agg(F.bool_or("recent").alias("now"), F.bool_or(~F.col("recent")).alias("then"))
    return flags.agg(
        F.count_if(F.col("now") & ~F.col("then")).alias("new"), F.count_if(F.col("then") & ~F.col("now")).alias("dead"), F.count_if(F.col("now")).alias("active")
    )


def run_coverage(points: DataFrame, runs: DataFrame) -> DataFrame:
    have = points.groupBy("run_id").agg(F.count_distinct("series_id").alias("have"))
    return runs.join(have, "run_id", "left").select("run_id", r4(ratio(F.coalesce("have", F.lit(0)), F.col("n_series"))).alias("coverage"))


def revision_volatility(points: DataFrame, runs: DataFrame, last: int = 12) -> DataFrame:
    """Mean over (series, week) of the runs' standard deviation of p50 over its mean, where two origins at least forecast it."""
    top = runs.filter("status in ('completed', 'partial')").orderBy(F.desc("run_id")).limit(last).select("run_id")
    kept = points.join(F.broadcast(top), "run_id").groupBy("series_id", "week_start_date").agg(
        F.count_distinct("origin").alias("origins"), F.stddev_samp("p50").alias("sd"), F.avg("p50").alias("mean"))
    return kept.filter("origins >= 2 and mean > 0").agg(r4(F.avg(F.col("sd") / F.col("mean"))).alias("volatility"), F.count(F.lit(1)).alias("n"))


def drift_windows(history: DataFrame, origin: DataFrame, weeks: int = 13, ago: int = 52) -> DataFrame:
    """side (current, reference), id, units, sell_price: the weeks up to the one-row origin and the same weeks a year before."""
    rows = history.filter("n_days = 7").crossJoin(F.broadcast(origin))
    end = F.date_diff("origin", "week_start_date")
    side = F.when(end.between(0, 7 * weeks - 1), "current").when(end.between(7 * ago, 7 * (ago + weeks) - 1), "reference")
    return rows.withColumn("side", side).filter("side is not null").select("side", "id", "week_start_date", "units", "sell_price")


def psi(windows: DataFrame, column: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """Population stability index over the reference's exact deciles; no_data with fewer than two edges."""
    rows = windows.filter(F.col(column).isNotNull()).select("side", F.col(column).cast("double").alias("x"))
    cuts = [k / bins for k in range(bins + 1)]
    edges = rows.filter("side = 'reference'").agg(F.array_distinct(F.percentile("x", F.array(*map(F.lit, cuts)))).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = rows.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col("x"))))
    counts = binned.groupBy("bin").agg(F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "current").alias("c"), F.max(F.size("edges")).alias("n_edges"))
    all_bins = edges.select(F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"), F.size("edges").alias("n_edges"))
    counts = all_bins.join(counts.drop("n_edges"), "bin", "left").fillna(0, ["r", "c"])
    total = lambda c: F.sum(c).over(Window.partitionBy("n_edges"))  # noqa: E731  a dozen bins
    shares = counts.withColumns({"rs": F.greatest(ratio(F.col("r"), total("r")), F.lit(eps)), "cs": F.greatest(ratio(F.col("c"), total("c")), F.lit(eps))})
    value = shares.agg(F.max("n_edges").alias("n_edges"), F.sum((F.col("cs") - F.col("rs")) * F.ln(F.col("cs") / F.col("rs"))).alias("psi"))
    known = F.when(F.col("n_edges") >= 2, F.col("psi"))
    status = F.when(known.isNull(), "no_data").when(known < 0.1, "narrow").when(known < 0.25, "mid").otherwise("wide")
    return value.select(F.lit(column).alias("feature"), r4(known).alias("psi"), status.alias("status"))


def ks(windows: DataFrame, column: str) -> DataFrame:
    """Largest gap between the two distribution functions. Values are summed up first, so the running sums go over distinct values."""
    counts = windows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(
        F.count_if(F.col("side") == "reference").alias("r"), F.count_if(F.col("side") == "current").alias("c"))
    # Ranges of x are counted apart, then each range starts from the sum of those before it: no task holds all values.
    parts = counts.repartitionByRange("x").withColumn("part", F.spark_partition_id())
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part").agg(F.sum("r").alias("pr"), F.sum("c").alias("pc"))
    sums = sums.select("part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(b) for c, b in (("pr", "br"), ("pc", "bc"))))
    run = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    totals = counts.agg(F.sum("r").alias("tr"), F.sum("c").alias("tc"))
    cdf = parts.join(F.broadcast(sums), "part").withColumns({"fr": F.col("br") + F.sum("r").over(run), "fc": F.col("bc") + F.sum("c").over(run)})
    gap = F.abs(ratio(F.col("fr"), F.col("tr")) - ratio(F.col("fc"), F.col("tc")))
    return cdf.crossJoin(F.broadcast(totals)).agg(r4(F.max(gap)).alias("ks")).select(F.lit(column).alias("feature"), "ks")


def planning_bias(by_state: DataFrame) -> DataFrame:
    return by_state.agg(F.max(F.abs("bias")).alias("planning_bias"))


def gate(report: DataFrame) -> DataFrame:
    """warnings (array) and degraded for a row of measures; a measure that is missing or null never warns."""
    rule = lambda name, test: F.when(test, F.lit(name))
    have = lambda c: F.col(c) if c in report.columns else F.lit(None).cast("double")
    over = lambda c: have(c) > LIMITS[c]
    under = lambda c: have(c) < LIMITS[c]
    rules = [
        rule("wmape", over("wmape")), rule("bias", F.abs(have("bias")) > LIMITS["bias"]), rule("coverage", under("coverage")),
        rule("drift", F.coalesce(over("psi"), F.lit(False)) | F.coalesce(over("ks"), F.lit(False))), rule("planning_bias", over("planning_bias")),
        rule("promo_wmape", over("promo_wmape")), rule("fva", have("fva") <= LIMITS["fva"]), rule("completeness", under("completeness")),
        rule("revision", over("revision")), rule("run_coverage", under("run_coverage")), rule("artifact_age", over("artifact_age")),
    ]
    warnings = F.filter(F.array(*rules), lambda w: w.isNotNull())
    return report.withColumn("warnings", warnings).withColumn("degraded", F.size("warnings") > 0)


def gauges(report: DataFrame) -> DataFrame:
    """Long form: one row a measure; a measure without a value has none here either."""
    names = [c for c, kind in report.dtypes if kind in ("double", "bigint", "int")]
    return report.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names))).alias("g")).select("g.*").filter("value is not null")


def labelled(parts: DataFrame, prefix: str = "forecast") -> DataFrame:
    """name, labels, value: a gauge for each measure of each part of breakdowns, labelled by what it is broken down by; NaN where a measure has no value."""
    measures = [c for c in ("wmape", "bias", "coverage") if c in parts.columns]
    each = F.array(*(F.struct(F.lit(f"{prefix}_{m}").alias("name"), F.coalesce(F.col(m), F.lit(float("nan"))).alias("value")) for m in measures))
    labels = F.concat(F.lit("{"), F.col("by"), F.lit('="'), F.col("key"), F.lit('"}'))
    return parts.select(labels.alias("labels"), F.explode(each).alias("g")).select("g.name", "labels", "g.value")


def alerts(g: DataFrame) -> DataFrame:
    """Names of the gauges beyond the gate's limits; limits from below are marked by their side."""
    low = {"coverage", "fva", "completeness", "run_coverage"}
    limits = F.create_map(*(F.lit(x) for k, v in LIMITS.items() for x in (k, v)))
    limit, value = F.try_element_at(limits, F.col("name")), F.when(F.col("name") == "bias", F.abs("value")).otherwise(F.col("value"))
    fires = F.when(F.col("name") == "fva", value <= limit).when(F.col("name").isin(*low), value < limit).otherwise(value > limit)
    return g.withColumn("limit", limit).filter("limit is not null").select("name", "value", "limit", fires.alias("firing"))
