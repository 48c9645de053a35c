"""Forecasts that ripen: points meet the weeks that they forecast as these arrive, or are given up as overdue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matured(points: DataFrame, arrivals: DataFrame, grace_days: int = 14, delay_days: int = 7) -> DataFrame:
    """Streams of points (series_id, week_start_date, due, ...) and arrivals (id, week, at, units) joined; units is null where the week is overdue.

    A week that arrives within grace_days of the point's due time is its actual. Both sides have a watermark delay_days behind their
    latest time, so a point's state is dropped, and its row without units emitted, once no arrival can match it any more; an arrival's once no
    point can. State is bounded by the grace and the delay, not by the history.
    """
    left = points.withWatermark("due", f"{delay_days} days")
    right = arrivals.select(F.col("id").alias("__id"), F.col("week").alias("__week"), "at", "units").withWatermark("at", f"{delay_days} days")
    near = (F.col("at") >= F.col("due")) & (F.col("at") <= F.col("due") + F.expr(f"INTERVAL {grace_days} DAYS"))
    return left.join(right, (F.col("series_id") == F.col("__id")) & (F.col("week_start_date") == F.col("__week")) & near, "leftOuter").drop("__id", "__week")
