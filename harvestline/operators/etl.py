"""From daily tables to the weekly panel: melting, calendar, prices, roll-ups, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestline.functions import flag, ratio, week_of


def calendar(days: DataFrame) -> DataFrame:
    """One row a day with d_num (days since the first), week, weekday and snap flags, event names and has_event.

    days has date, event_name_1 and event_name_2.
    """
    first = F.min("date").over(Window.partitionBy())  # a calendar has a row a day
    return days.withColumns({
        "d_num": (F.date_diff(F.col("date"), first) + 1).cast("int"),
        "week_start_date": week_of(F.col("date")),
        "has_event": (F.col("event_name_1").isNotNull().cast("int") + F.col("event_name_2").isNotNull().cast("int")),
    })


def weekly_calendar(cal: DataFrame) -> DataFrame:
    return cal.groupBy("week_start_date").agg(
        F.min("date").alias("first_day"), F.sum("snap_a").alias("snap_a_days"), F.sum("snap_b").alias("snap_b_days"),
        F.sum("has_event").alias("event_days"), F.count(F.lit(1)).alias("n_days"),
    )


def melt_daily(wide: DataFrame, keys: list[str], cal: DataFrame) -> DataFrame:
    """Wide d_1, d_2, ... columns to rows of (keys, d_num, units), with the calendar's columns."""
    days = [c for c in wide.columns if c.startswith("d_") and c[2:].isdigit()]
    long = wide.unpivot(keys, days, "d", "units").withColumn("d_num", F.substring("d", 3, 9).cast("int")).drop("d")
    return long.join(F.broadcast(cal), "d_num", "left")


def snap_by_state(rows: DataFrame) -> DataFrame:
    """The snap flag of the row's own state."""
    pick = F.when(F.col("state_id") == "ASIA", F.col("snap_a")).when(F.col("state_id") == "EUROPE", F.col("snap_b")).otherwise(F.col("snap_c"))
    return rows.withColumn("snap", pick)


def snap_or_zero(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The snap flag that the row's state has by columns; 0 for states that have none."""
    pick = F.lit(0)
    for state, column in columns.items():
        pick = F.when(F.col("state_id") == state, F.coalesce(F.col(column), F.lit(0))).otherwise(pick)
    return rows.withColumn("snap", pick.cast("int"))


def join_prices(rows: DataFrame, prices: DataFrame) -> DataFrame:
    """Left join of weekly prices by store and item; revenue at that price, and availability."""
    return rows.join(prices, ["store_id", "item_id", "wm_yr_wk"], "left").withColumns({
        "revenue": F.col("units") * F.col("sell_price"), "available": flag(F.col("sell_price").isNotNull()),
    })


def weekly_rollup(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Daily rows to weeks: a week without any price has revenue 0 and no price."""
    return rows.groupBy(*keys).agg(
        F.min("date").alias("week_start_date"), F.sum("units").cast("long").alias("units"), F.coalesce(F.sum("revenue"), F.lit(0.0)).alias("revenue"),
        F.avg("sell_price").alias("sell_price"), F.sum("available").cast("int").alias("available_days"), F.count(F.lit(1)).cast("int").alias("n_days"),
    )


def weekly_events(cal: DataFrame, types: tuple[str, ...] = ("Cultural", "National", "Religious", "Sporting")) -> DataFrame:
    """Days with events of each type in each week, weeks without events included; both event slots count."""
    slots = cal.select("week_start_date", F.explode(F.array(F.col("event_type_1"), F.col("event_type_2"))).alias("type"))
    return slots.groupBy("week_start_date").agg(*(F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in types))


def add_events(panel: DataFrame, events: DataFrame) -> DataFrame:
    """Many-to-one left join; a week that is twice in events fails the job rather than double rows."""
    once = events.withColumn("ok", F.assert_true(F.count(F.lit(1)).over(Window.partitionBy("week_start_date")) == 1, "a week is twice in the events"))
    once = once.filter(F.col("ok").isNull()).drop("ok")
    joined = panel.join(F.broadcast(once), "week_start_date", "left")
    return joined.fillna(0, [c for c in events.columns if c != "week_start_date"])


def load_window(panel: DataFrame, window: int) -> DataFrame:
    """Full weeks after the week that is window-th from the end: window - 1 weeks."""
    full = panel.filter("n_days = 7")
    weeks = full.select("week_start_date").distinct().orderBy(F.desc("week_start_date")).limit(window)
    return full.join(F.broadcast(weeks.agg(F.min("week_start_date").alias("after"))), F.col("week_start_date") > F.col("after")).drop("after")


def series_dim(panel: DataFrame) -> DataFrame:
    return panel.select("id", "item_id", "dept_id", "cat_id", "store_id", "state_id").dropDuplicates(["id"])


def price_per_unit(rows: DataFrame) -> DataFrame:
    return rows.withColumn("sell_price", ratio(F.col("revenue"), F.col("units")))


def upsert(points: DataFrame, updates: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The last writer of each key: the highest version, and of equal versions the update."""
    both = points.withColumn("__update", F.lit(0)).unionByName(updates.withColumn("__update", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__update"))
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__update")
