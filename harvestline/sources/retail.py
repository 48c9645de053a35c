"""Reading tables and shaping them into the weekly panel, forecast runs and forecast points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestline.functions import ratio, week_of
from harvestline.sources.shared import cut

KEYS = ["id", "item_id", "dept_id", "cat_id", "store_id", "state_id"]
RUNS, HORIZON, CHUNK = 6, 8, 300
#: ISO weeks of the made-up calendar that have events, and their types; fixed values of the fixture.
EVENT_WEEKS = {1: "National", 6: "Sporting", 13: "Religious", 22: "Cultural", 27: "National", 36: "National", 47: "National", 51: "Religious"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A typed CSV scan; nothing is inferred."""
    return spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")


def write_slice(panel: DataFrame, path: str, by: str = "cat_id") -> None:
    """Snappy Parquet partitioned so that a slice is read by partition pruning."""
    panel.write.mode("overwrite").partitionBy(by).parquet(path, compression="snappy")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: item (brand), store (nation), state (region), day, quantity and revenue."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    stores = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("store_id"), F.col("r_name").alias("state_id"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    joined = lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey).join(stores, F.col("s_nationkey") == F.col("n_nationkey"))
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")
    return joined.select(F.col("p_brand").alias("item_id"), "store_id", "state_id", F.to_date("l_shipdate").alias("day"), "l_quantity", revenue.alias("revenue"))


def weekly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and revenue of the (item, store, week) cells that have sales."""
    rows = sales(spark, sf_dir).withColumn("week_start_date", week_of(F.col("day")))
    n = F.regexp_extract("item_id", "([0-9]+)$", 1).cast("int")
    cells = rows.groupBy("item_id", "store_id", "state_id", "week_start_date").agg(F.sum("l_quantity").cast("long").alias("units"), F.sum("revenue").cast("double").alias("revenue"))
    return cells.select(
        F.concat_ws("_", "item_id", "store_id").alias("id"), "item_id", F.concat(F.lit("D"), (n % 5).cast("string")).alias("dept_id"),
        F.concat(F.lit("C"), (n % 5 % 2).cast("string")).alias("cat_id"), "store_id", "state_id", "week_start_date", "units", "revenue",
    )


def add_calendar(df: DataFrame) -> DataFrame:
    """snap_days, event_days, n_days and wm_yr_wk of each week; the last week of the table counts as cut short."""
    woy = F.weekofyear("week_start_date")
    last = F.max("week_start_date").over(Window.partitionBy("id"))  # the panel is dense: each series has every week
    return df.withColumns({
        "snap_days": F.pmod(woy * 3 + F.length("state_id"), F.lit(8)).cast("int"),
        "event_days": F.when(woy.isin(*EVENT_WEEKS), 1 + woy % 2).otherwise(0).cast("int"),
        "n_days": F.when(F.col("week_start_date") == last, 5).otherwise(7).cast("int"),
        "wm_yr_wk": (F.year("week_start_date") * 100 + woy).cast("int"),
    })


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense weekly panel: every series in every week, zero where nothing was sold."""
    cells = cut(weekly_cells(spark, sf_dir))  # the table is read and summed once for the series, the weeks and the cells
    weeks = cells.select("week_start_date").distinct()
    grid = cells.select(*KEYS).distinct().join(F.broadcast(weeks))  # series x weeks is the panel itself; weeks are few by nature
    by_week = Window.partitionBy("id").orderBy("week_start_date")
    dense = grid.join(cells.select("id", "week_start_date", "units", "revenue"), ["id", "week_start_date"], "left")
    first = F.min(F.when(F.col("units") > 0, F.col("week_start_date"))).over(Window.partitionBy("id"))
    dense = dense.withColumns({
        "sell_price": F.last(ratio(F.col("revenue"), F.col("units")), ignorenulls=True).over(by_week),
        "available_days": F.when(F.col("week_start_date") >= first, 7).otherwise(0).cast("int"),
    })
    dense = dense.withColumns({"units": F.coalesce("units", F.lit(0)), "revenue": F.coalesce("revenue", F.lit(0.0))})
    return add_calendar(dense).select(*KEYS, "week_start_date", "wm_yr_wk", "units", "revenue", "sell_price", "snap_days", "event_days", "available_days", "n_days")


def ranked_weeks(df: DataFrame) -> DataFrame:
    """The distinct weeks of a frame and back, 1 for the last one. One row for each week, so the window without a key stays small."""
    return df.select("week_start_date").distinct().withColumn("back", F.row_number().over(Window.orderBy(F.desc("week_start_date"))))


def runs(p: DataFrame) -> DataFrame:
    """Forecast runs two weeks apart, the last nine weeks before the end; statuses take turns."""
    run = F.sequence(F.lit(1), F.lit(RUNS))
    weeks = ranked_weeks(p).withColumn("run_id", F.explode(run)).filter(F.col("back") == 21 - 2 * F.col("run_id"))
    n_series = p.agg(F.countDistinct("id").alias("n_series"))
    status = F.element_at(F.array(F.lit("completed"), F.lit("partial"), F.lit("failed")), F.col("run_id") % 3 + 1)
    store = F.when(F.col("run_id") % 2 == 0, F.lit('{"store_id":"NATION_3"}')).otherwise(F.lit("{}"))
    return weeks.crossJoin(F.broadcast(n_series)).select(
        F.col("run_id").cast("long").alias("run_id"), F.col("week_start_date").alias("origin"), F.lit(HORIZON).alias("horizon_weeks"), store.alias("filter_json"),
        status.alias("status"), "n_series", F.ceil(F.col("n_series") / CHUNK).cast("long").alias("n_chunks"),
    )


def points(p: DataFrame, r: DataFrame) -> DataFrame:
    """Forecast points of the runs: p50 is the mean of the series' last four weeks, p10 and p90 half and one and a half of it."""
    near = (F.col("week_start_date") <= F.col("origin")) & (F.col("week_start_date") > F.date_sub("origin", 28))
    level = p.select("id", "week_start_date", "units").join(F.broadcast(r.select("run_id", "origin")), near).groupBy("run_id", "origin", "id").agg(F.avg("units").alias("p50"))
    out = level.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    return out.select(
        "run_id", F.col("id").alias("series_id"), F.expr("date_add(origin, 7 * h)").alias("week_start_date"), "h",
        (0.5 * F.col("p50")).alias("p10"), "p50", (1.5 * F.col("p50")).alias("p90"), "origin",
    )


def with_back(p: DataFrame) -> DataFrame:
    """The panel with each week's distance from the end, 1 for the last."""
    return p.join(F.broadcast(ranked_weeks(p)), "week_start_date")  # one row for each week


def holdout(p: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train (up to the origin, the ninth week from the end) and the eight weeks after it."""
    rows = with_back(p)
    return rows.filter("back >= 9").drop("back"), rows.filter("back <= 8").drop("back")


def origin_of(p: DataFrame, back: int = 9) -> DataFrame:
    """One row: the week that is so far from the end."""
    return ranked_weeks(p).filter(F.col("back") == back).select(F.col("week_start_date").alias("origin"))


def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days on which something was sold, with made-up snap flags and events: the fixture of the calendar operators."""
    days = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    dom, doy = F.dayofmonth("date"), F.dayofyear("date")
    name = F.when(doy.isin(1, 185, 359), "holiday").when(doy % 30 == 7, "match")
    kind = F.when(doy.isin(1, 185), "National").when(doy == 359, "Religious").when(doy % 30 == 7, "Sporting")
    second = F.when(doy % 60 == 7, "fair")
    return days.select(
        "date", (dom <= 10).cast("int").alias("snap_a"), (dom % 2).cast("int").alias("snap_b"), (dom > 20).cast("int").alias("snap_c"),
        name.alias("event_name_1"), kind.alias("event_type_1"), second.alias("event_name_2"), F.when(second.isNotNull(), "Cultural").alias("event_type_2"),
    )


def chunk_log(p: DataFrame, size: int = CHUNK) -> DataFrame:
    """A made-up log of chunk transitions of the runs: some chunks fail, some never end, some claim an end that they may not."""
    chunk = F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)).alias("idx")
    rows = runs(p).select("run_id", "origin", chunk)
    k = (F.col("run_id") * 7 + F.col("idx") * 3) % 5
    end = F.when(k == 0, "failed").when(k == 4, "completed").otherwise("completed")
    event = lambda seq, status: F.struct(F.lit(seq).alias("seq"), status.alias("status"))
    full = F.array(event(1, F.lit("queued")), event(2, F.lit("processing")), event(3, end), event(4, F.lit("completed")))
    log = F.when(k == 1, F.slice(full, 1, 2)).when(k == 2, F.filter(full, lambda e: e["seq"] != 2)).otherwise(full)
    at = (F.unix_timestamp(F.col("origin").cast("timestamp")) + 600 * F.col("e.seq")).cast("timestamp").cast("timestamp_ntz")
    return rows.select("run_id", "idx", "origin", F.explode(log).alias("e")).select("run_id", "idx", F.col("e.seq").alias("seq"), F.col("e.status").alias("status"), at.alias("at"))
