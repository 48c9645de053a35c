"""Exploratory queries over the weekly panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestline.sources.shared import cut
from harvestline.functions import mean_of, r4, ratio


def structure(p: DataFrame) -> DataFrame:
    names = ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "week_start_date")
    return p.agg(*(F.count_distinct(n).alias(f"n_{n}") for n in names), F.min("week_start_date").alias("first_week"), F.max("week_start_date").alias("last_week"), F.count(F.lit(1)).alias("n_rows"))


def quality(p: DataFrame) -> DataFrame:
    return p.agg(
        F.count_if(F.col("units") == 0).alias("zero_weeks"), F.count_if(F.col("sell_price").isNull()).alias("no_price"), F.count_if(F.col("available_days") == 0).alias("unavailable"),
        F.count_if(F.col("n_days") < 7).alias("short_weeks"), r4(mean_of(F.col("units") == 0)).alias("zero_share"),
    )


def oos(p: DataFrame) -> DataFrame:
    return p.groupBy("week_start_date").agg(r4(mean_of(F.col("available_days") == 0)).alias("oos_share"))


def target(p: DataFrame) -> DataFrame:
    qs = (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)
    cut = p.agg(F.percentile("units", F.array(*map(F.lit, qs))).alias("q"), r4(mean_of(F.col("units") == 0)).alias("zero_share"))
    rows = p.crossJoin(F.broadcast(cut))
    out = rows.agg(F.first("q").alias("q"), F.first("zero_share").alias("zero_share"), r4(mean_of(F.col("units") > F.col("q")[4])).alias("over_p99"))
    return out.select(*(r4(F.col("q")[i]).alias(f"p{str(q)[2:]}") for i, q in enumerate(qs)), "zero_share", "over_p99")


def weekly_total(p: DataFrame) -> DataFrame:
    return p.groupBy("week_start_date").agg(F.sum("units").alias("units"), F.sum("revenue").alias("revenue"))


def rolling_total(p: DataFrame) -> DataFrame:
    """Centred mean of 13 weeks, where 4 at least are there. Windows without a key go over one row a week."""
    frame = Window.orderBy("week_start_date").rowsBetween(-6, 6)
    return weekly_total(p).select("week_start_date", "units", r4(F.when(F.count("units").over(frame) >= 4, F.avg("units").over(frame))).alias("rolling"))


def yoy(p: DataFrame) -> DataFrame:
    years = weekly_total(p).groupBy(F.year("week_start_date").alias("year")).agg(F.avg("units").alias("units"), F.avg("revenue").alias("revenue"))
    before = F.lag("units").over(Window.orderBy("year"))
    return years.select("year", r4("units").alias("units_per_week"), F.round("revenue", 2).alias("revenue_per_week"), F.round(100 * (ratio(F.col("units"), before) - 1), 2).alias("yoy_pct"))


def season(p: DataFrame, unit: str = "month") -> DataFrame:
    """Quartiles of the weekly total by month or woy, the week of the year."""
    of = {"month": F.month, "woy": F.weekofyear}[unit]
    q = F.percentile("units", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = weekly_total(p).groupBy(of("week_start_date").alias(unit)).agg(q.alias("q"), F.count(F.lit(1)).alias("n"))
    return out.select(unit, "n", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def acf(p: DataFrame, lags: int = 60) -> DataFrame:
    """Autocorrelation of the weekly total; an equi-join on the shifted row number, over one row a week."""
    rows = weekly_total(p).select(F.row_number().over(Window.orderBy("week_start_date")).alias("i"), F.col("units").cast("double").alias("y"))
    rows = rows.withColumn("d", F.col("y") - F.avg("y").over(Window.partitionBy()))
    shifted = rows.select(F.explode(F.sequence(F.lit(0), F.lit(lags))).alias("lag"), "i", "d").select("lag", (F.col("i") + F.col("lag")).alias("i"), F.col("d").alias("d2"))
    var = rows.agg(F.sum(F.col("d") * F.col("d")).alias("v"))
    return rows.join(shifted, "i").groupBy("lag").agg(F.sum(F.col("d") * F.col("d2")).alias("c")).crossJoin(F.broadcast(var)).select("lag", r4(F.col("c") / F.col("v")).alias("acf"))


def pivot(p: DataFrame, states: list[str], value: str = "units") -> DataFrame:
    return p.groupBy("cat_id").pivot("state_id", states).agg(F.sum(value))


def share(p: DataFrame) -> DataFrame:
    cats = p.groupBy("cat_id").agg(F.sum("revenue").alias("revenue"), F.avg("sell_price").alias("price"))
    return cats.select("cat_id", r4(ratio(F.col("revenue"), F.sum("revenue").over(Window.partitionBy()))).alias("share"), F.round("price", 2).alias("avg_price"))


def _ranked(p: DataFrame, key: str) -> DataFrame:
    """Units of each entity with place (1 for the most, ties by name), cum (units up to and with it), n_all and grand over all entities.

    The order is cut into ranges that start from the sums of those before them, so no task has all entities.
    """
    total = cut(p.groupBy(key).agg(F.sum("units").alias("units")).repartitionByRange(F.desc("units"), key).withColumn("part", F.spark_partition_id()))
    sums = total.groupBy("part").agg(F.sum("units").alias("s"), F.count(F.lit(1)).alias("c"))
    before = lambda c: F.coalesce(F.sum(c).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = Window.partitionBy()  # a row a range
    sums = sums.select("part", before("s").alias("s_before"), before("c").alias("c_before"), F.sum("s").over(every).alias("grand"), F.sum("c").over(every).alias("n_all"))
    order = Window.partitionBy("part").orderBy(F.desc("units"), key)
    rows = total.join(F.broadcast(sums), "part")
    return rows.select(key, "units", (F.col("c_before") + F.row_number().over(order)).alias("place"), (F.col("s_before") + F.sum("units").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("cum"), "n_all", "grand")


def pareto(p: DataFrame, key: str = "id", steps: tuple[float, ...] = (0.5, 0.8, 0.9)) -> DataFrame:
    """How many entities make up each share of the units, largest first (ties by name)."""
    rows = _ranked(p, key).withColumn("cum_before", ratio(F.col("cum") - F.col("units"), F.col("grand")))
    return rows.agg(*(F.count_if(F.col("cum_before") < s).alias(f"n_{int(100 * s)}") for s in steps), F.count(F.lit(1)).alias("n_all"))


def lorenz(p: DataFrame, key: str = "id", points: int = 20) -> DataFrame:
    """step, place, share: the part of the units that the first entities make up, at each of so many equal steps of their number."""
    step = lambda place: F.floor(place * points / F.col("n_all"))
    rows = _ranked(p, key).withColumn("step", step(F.col("place"))).filter(F.col("step") > step(F.col("place") - 1))
    return rows.select("step", "place", r4(ratio(F.col("cum"), F.col("grand"))).alias("share"))


def syntetos_boylan(p: DataFrame) -> DataFrame:
    nonzero = F.when(F.col("units") > 0, F.col("units"))
    s = p.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count(nonzero).alias("nnz"), F.stddev_pop(nonzero).alias("sd"), F.avg(nonzero).alias("mean"))
    s = s.withColumns({"adi": ratio(F.col("n"), F.col("nnz")), "cv2": F.pow(ratio(F.col("sd"), F.col("mean")), 2)})
    kind = F.when(F.col("nnz") < 2, "no_demand").when((F.col("adi") < 1.32) & (F.col("cv2") < 0.49), "smooth").when(F.col("cv2") < 0.49, "intermittent").when(F.col("adi") < 1.32, "erratic").otherwise("lumpy")
    return s.select("id", r4("adi").alias("adi"), r4("cv2").alias("cv2"), kind.alias("kind"))


def promo_lift(priced: DataFrame) -> DataFrame:
    """Share of promoted weeks and mean units with and without promotion, by category."""
    rows = priced.filter(F.col("price_rel").isNotNull())
    out = rows.groupBy("cat_id").agg(mean_of(F.col("is_promo") == 1).alias("s"), F.avg(F.when(F.col("is_promo") == 1, F.col("units"))).alias("on"), F.avg(F.when(F.col("is_promo") == 0, F.col("units"))).alias("off"))
    return out.select("cat_id", r4("s").alias("promo_share"), r4(ratio(F.col("on"), F.col("off"))).alias("lift"))


def snap(p: DataFrame) -> DataFrame:
    return p.groupBy("state_id", "snap_days").agg(r4(F.avg("units")).alias("mean_units"))


def event_lift(p: DataFrame, n: int = 12) -> DataFrame:
    """Mean weekly total of each event week against that of weeks without events, largest first."""
    weeks = p.groupBy("week_start_date").agg(F.sum("units").alias("units"), F.max("event_days").alias("event_days")).withColumn("woy", F.weekofyear("week_start_date"))
    base = weeks.filter("event_days = 0").agg(F.avg("units").alias("base"))
    out = weeks.filter("event_days > 0").groupBy("woy").agg(F.avg("units").alias("mean")).crossJoin(F.broadcast(base))
    return out.select("woy", r4(F.col("mean") / F.nullif("base", F.lit(0.0))).alias("lift")).orderBy(F.desc("lift"), "woy").limit(n)


def named_event_lift(p: DataFrame, cal: DataFrame, n: int = 12) -> DataFrame:
    """Mean weekly total of the weeks of each named event against that of weeks without one, largest first."""
    names = F.array_compact(F.array("event_name_1", "event_name_2"))
    named = cal.select("week_start_date", F.explode(names).alias("event")).distinct()
    total = weekly_total(p).select("week_start_date", "units")
    base = total.join(named, "week_start_date", "left_anti").agg(F.avg("units").alias("base"))
    out = total.join(named, "week_start_date").groupBy("event").agg(F.avg("units").alias("mean")).crossJoin(F.broadcast(base))  # one row
    return out.select("event", r4(F.col("mean") / F.nullif("base", F.lit(0.0))).alias("lift")).orderBy(F.desc("lift"), "event").limit(n)


def describe(p: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of numeric columns, a row each, in one pass over the rows."""
    long = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.*")
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy("name").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev("x").alias("sd"), F.min("x").alias("least"), F.max("x").alias("most"), q.alias("q"))
    return out.select("name", "n", *(r4(c).alias(c) for c in ("mean", "sd", "least", "most")), *(r4(F.col("q")[i]).alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def describe_text(p: DataFrame, columns: list[str]) -> DataFrame:
    """Count, number of different values, most frequent value (ties by value) and its count of text columns, a row each."""
    long = p.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns))).alias("v")).select("v.*")
    counts = long.filter("value is not null").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy("name").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_unique"), F.min(F.struct((-F.col("n")).alias("less"), "value")).alias("top"))
    return out.select("name", "n", "n_unique", F.col("top.value").alias("top"), (-F.col("top.less")).alias("freq"))


def correlation(p: DataFrame, key: str = "state_id") -> DataFrame:
    rows = p.groupBy(key, "week_start_date").agg(F.sum("units").cast("double").alias("y"))
    other = rows.select(F.col(key).alias("other"), "week_start_date", F.col("y").alias("y2"))
    return rows.join(other, "week_start_date").groupBy(key, "other").agg(r4(F.corr("y", "y2")).alias("corr"))


def age(p: DataFrame) -> DataFrame:
    end = p.agg(F.max("week_start_date").alias("end"))
    first = p.filter("units > 0").groupBy("id").agg(F.min("week_start_date").alias("first")).crossJoin(F.broadcast(end))
    rows = first.withColumn("weeks", F.round(F.date_diff("end", "first") / 7).cast("int"))
    return rows.agg(F.min("weeks").alias("youngest"), F.max("weeks").alias("oldest"), r4(mean_of(F.col("weeks") < 52)).alias("under_52"), r4(mean_of(F.col("weeks") < 13)).alias("under_13"))


def split(p: DataFrame, test: int = 8, val: int = 8) -> DataFrame:
    end = p.filter("n_days = 7").agg(F.max("week_start_date").alias("end"))
    return end.select(F.date_sub("end", 7 * (test + val)).alias("train_end"), F.date_sub("end", 7 * test).alias("val_end"), F.col("end").alias("test_end"))


def missing(p: DataFrame) -> DataFrame:
    return p.agg(
        *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in ("units", "revenue", "sell_price")),
        r4(ratio(F.count(F.lit(1)), F.count_distinct("id") * F.count_distinct("week_start_date"))).alias("completeness"),
    )


def zero_share(p: DataFrame) -> DataFrame:
    by = p.groupBy("id").agg(mean_of(F.col("units") == 0).alias("z"))
    return by.agg(r4(F.percentile("z", F.lit(0.5))).alias("median"), r4(F.avg("z")).alias("mean"), r4(F.percentile("z", F.lit(0.95))).alias("p95"))


def availability(p: DataFrame) -> DataFrame:
    return p.agg(r4(mean_of(F.col("available_days") == 0)).alias("none"), r4(mean_of(F.col("available_days") == 7)).alias("full"), F.bool_and(F.col("available_days").isin(0, 7)).alias("is_binary"))


def top_k(p: DataFrame, group: list[str], k: int = 15) -> DataFrame:
    """The k series of the most revenue in each group, ties by id."""
    total = p.groupBy(*group, "id").agg(F.sum("revenue").alias("revenue"))
    rn = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("revenue"), "id"))
    return total.withColumn("rn", rn).filter(F.col("rn") <= k).select(*group, "id", F.round("revenue", 0).alias("revenue"), "rn")
