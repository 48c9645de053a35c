"""Life of forecast runs: chunk plans, states from a log of transitions, progress, catalogues and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")
ACTIVE = ("new", "queued", "processing")


def chunk_plan(ids: DataFrame, size: int = 300) -> DataFrame:
    """idx, n_series, first_id and last_id of chunks of ids in order. Ids are ranked within ranges, so no task sees them all."""
    parts = ids.select("id").distinct().repartitionByRange("id").withColumn("part", F.spark_partition_id())
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("id")) + F.col("before") - 1
    ranked = parts.join(F.broadcast(before), "part").withColumn("idx", F.floor(rank / size).cast("long"))
    return ranked.groupBy("idx").agg(F.count(F.lit(1)).alias("n_series"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def create_run(ids: DataFrame, run_id: int, size: int = 300) -> DataFrame:
    """The chunks of a new run, all queued; a slice without series is an error, and no run."""
    if ids.isEmpty():
        raise ValueError("the slice has no series")
    return chunk_plan(ids, size).select(F.lit(run_id).cast("long").alias("run_id"), "idx", "n_series", F.lit("queued").alias("status"))


def fail_run(runs: DataFrame, unsent: DataFrame) -> DataFrame:
    """runs, those that are not over and whose chunks could not be sent (run_id in unsent) failed."""
    lost = unsent.select("run_id").distinct().withColumn("lost", F.lit(True))
    status = F.when(F.col("lost") & F.col("status").isin(*ACTIVE), "failed").otherwise(F.col("status"))
    return runs.join(lost, "run_id", "left").withColumn("status", status).drop("lost")


def payload(chart: DataFrame, *values: str) -> DataFrame:
    """Dates as text and values to two places, as a chart is sent them."""
    dates = [c for c, kind in chart.dtypes if kind == "date"]
    return chart.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates} | {v: F.round(F.col(v).cast("double"), 2) for v in values})


def chunk_state(log: DataFrame) -> DataFrame:
    """The state after the valid transitions of a log (run_id, idx, seq, status): queued, processing, then completed or failed.

    A chunk is processing only after being queued and terminal only after processing, and the first terminal state stays.
    """
    at = lambda s: F.min(F.when(F.col("status") == s, F.col("seq")))
    q = log.groupBy("run_id", "idx").agg(at("queued").alias("q"), F.collect_list(F.struct("seq", "status")).alias("all"))
    p = q.withColumn("p", F.array_min(F.transform(F.filter("all", lambda e: (e["status"] == "processing") & (e["seq"] > F.col("q"))), lambda e: e["seq"])))
    end = F.array_min(F.filter("all", lambda e: e["status"].isin(*TERMINAL) & (e["seq"] > F.col("p"))))
    state = F.when(end.isNotNull(), end["status"]).when(F.col("p").isNotNull(), "processing").when(F.col("q").isNotNull(), "queued").otherwise("new")
    return p.select("run_id", "idx", state.alias("status"))


def run_status(states: DataFrame) -> DataFrame:
    """completed when all chunks have ended, partial if any of those failed, processing before."""
    out = states.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin(*TERMINAL)).alias("done"), F.count_if(F.col("status") == "failed").alias("failed"))
    status = F.when(F.col("done") < F.col("n"), "processing").when(F.col("failed") > 0, "partial").otherwise("completed")
    return out.select("run_id", status.alias("status"))


def run_progress(states: DataFrame) -> DataFrame:
    out = states.groupBy("run_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.col("status").isin(*TERMINAL)).alias("done"))
    return out.withColumn("percent", F.round(100.0 * F.col("done") / F.col("n_chunks"), 1))


def active_runs(runs: DataFrame) -> DataFrame:
    """One row: how many runs are not over."""
    return runs.agg(F.count_if(F.col("status").isin(*ACTIVE)).alias("active"))


def stale_chunks(log: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """Chunks that have been processing for too long at the time now; log has started_at."""
    last = log.groupBy("run_id", "idx").agg(F.max_by("status", "seq").alias("status"), F.max_by("at", "seq").alias("at"))
    return last.filter((F.col("status") == "processing") & (F.col("at") < F.expr(f"timestamp_ntz'{now}' - interval {minutes} minutes"))).select("run_id", "idx")


def recent_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    store = F.coalesce(F.get_json_object("filter_json", "$.store_id"), F.lit("all"))
    return runs.select("run_id", "origin", "status", store.alias("store")).orderBy(F.desc("run_id")).limit(n)


def catalog(points: DataFrame, dim: DataFrame) -> DataFrame:
    """Forecast and interval width of each series."""
    total = points.groupBy("series_id").agg(F.round(F.sum("p50"), 2).alias("total_p50"), F.round(F.sum(F.col("p90") - F.col("p10")), 2).alias("width"))
    return total.join(dim.withColumnRenamed("id", "series_id"), "series_id").orderBy(F.desc("total_p50"), "series_id")


def catalog_rollup(cat: DataFrame) -> DataFrame:
    return cat.rollup("state_id", "store_id", "dept_id").agg(F.round(F.sum("total_p50"), 2).alias("total_p50"), F.round(F.sum("width"), 2).alias("width"), F.count(F.lit(1)).alias("n"))


def width_bands(cat: DataFrame) -> DataFrame:
    """Relative width of each series against the median: narrow to 0.7 of it, mid to 1.3, else wide."""
    rel = F.when(F.col("total_p50") > 0, F.col("width") / F.col("total_p50")).otherwise(0.0)
    rows = cat.withColumn("rel", rel)
    med = rows.agg(F.percentile("rel", F.lit(0.5)).alias("med"))
    band = F.when(F.col("rel") <= 0.7 * F.col("med"), "narrow").when(F.col("rel") <= 1.3 * F.col("med"), "mid").otherwise("wide")
    return rows.crossJoin(F.broadcast(med)).select("series_id", F.round("rel", 4).alias("rel"), band.alias("band"))


def select_series(dim: DataFrame, state: str | None = None, store: str | None = None, dept: str | None = None, text: str | None = None) -> DataFrame:
    """Series that pass the filters that are given; text is looked for in the item and the id, in either case."""
    for name, value in (("state_id", state), ("store_id", store), ("dept_id", dept)):
        if value is not None:
            dim = dim.filter(F.col(name) == value)
    return dim if text is None else dim.filter(F.lower(F.concat_ws(" ", "item_id", "id")).contains(text.lower()))


def agg_forecast(points: DataFrame, dim: DataFrame) -> DataFrame:
    """Weekly sums over the chosen series; sums of quantiles only approximate the quantiles of sums."""
    chosen = points.join(dim.select(F.col("id").alias("series_id")), "series_id", "left_semi")
    return chosen.groupBy("week_start_date").agg(*(F.round(F.sum(c), 2).alias(c) for c in ("p10", "p50", "p90")))


def agg_history(history: DataFrame, dim: DataFrame, points: DataFrame, weeks: int = 60) -> DataFrame:
    first = points.agg(F.min("week_start_date").alias("first"))
    rows = history.filter("n_days = 7").join(dim.select("id"), "id", "left_semi").crossJoin(F.broadcast(first))
    return rows.filter(F.col("week_start_date") > F.date_sub("first", 7 * weeks)).groupBy("week_start_date").agg(F.sum("units").alias("units"))


def export_rows(points: DataFrame, dim: DataFrame) -> DataFrame:
    rows = points.join(dim.withColumnRenamed("id", "series_id"), "series_id")
    return rows.select("series_id", "item_id", "store_id", "week_start_date", "h", *(F.round(c, 2).alias(c) for c in ("p10", "p50", "p90"))).orderBy("series_id", "h")
