"""Contracts as counts of violations, all rules in one pass over all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKLY = {
    "units_negative": lambda: F.col("units") < 0,
    "revenue_negative": lambda: F.col("revenue") < 0,
    "price_not_positive": lambda: F.col("sell_price") <= 0,
    "snap_days_range": lambda: ~F.col("snap_days").between(0, 7),
    "event_days_range": lambda: ~F.col("event_days").between(0, 14),
    "available_days_range": lambda: ~F.col("available_days").between(0, 7),
    "n_days_range": lambda: ~F.col("n_days").between(1, 7),
    "id_null": lambda: F.col("id").isNull(),
}
FEATURES = {
    "h_range": lambda: ~F.col("h").between(1, 8),
    "lag_negative": lambda: F.col("lag_1") < 0,
    "share_range": lambda: ~F.col("nz_share_4").between(0, 1),
    "units_negative": lambda: F.col("units") < 0,
}
#: Rules of all features of the boosters: what they can be if their inputs are right.
BOOST = FEATURES | {
    "any_lag_negative": lambda: F.least(*(F.col(f"lag_{k}") for k in (1, 2, 3, 4, 8, 13, 26, 52))) < 0,
    "mean_negative": lambda: F.least(*(F.col(f"rmean_{m}") for m in (4, 8, 13, 26))) < 0,
    "std_negative": lambda: F.col("rstd_13") < 0,
    "max_below_mean": lambda: F.col("rmax_13") < F.col("rmean_13") - 1e-9,
    "long_share_range": lambda: ~F.col("nz_share_13").between(0, 1),
    "price_rel_negative": lambda: F.col("price_rel") < 0,
    "promo_range": lambda: ~F.col("is_promo").isin(0, 1) | ((F.col("is_promo") == 1) & ~(F.col("price_rel") < 0.9)),
    "since_promo_range": lambda: ~F.col("weeks_since_promo").between(0, 52) | ((F.col("is_promo") == 1) & (F.col("weeks_since_promo") != 0)),
    "season_range": lambda: (F.abs("woy_sin") > 1) | (F.abs("woy_cos") > 1) | ~F.col("month").between(1, 12) | ~F.col("is_year_end").isin(0, 1),
    "age_negative": lambda: F.col("age_weeks") < 0,
    "days_range": lambda: ~F.col("snap_days").between(0, 7) | ~F.col("event_days").between(0, 14),
    "category_null": lambda: F.col("item_id").isNull() | F.col("dept_id").isNull() | F.col("cat_id").isNull() | F.col("store_id").isNull() | F.col("state_id").isNull(),
}
OUTPUT = {
    "p10_negative": lambda: F.col("p10") < 0,
    "not_monotone": lambda: (F.col("p10") > F.col("p50")) | (F.col("p50") > F.col("p90")),
    "missing": lambda: F.col("p10").isNull() | F.col("p50").isNull() | F.col("p90").isNull(),
    "h_range": lambda: F.col("h") < 1,
}


CALENDAR = {
    "date_null": lambda: F.col("date").isNull(),
    "d_num_range": lambda: F.col("d_num") < 1,
    "snap_range": lambda: ~(F.col("snap_a").isin(0, 1) & F.col("snap_b").isin(0, 1) & F.col("snap_c").isin(0, 1)),
    "has_event_range": lambda: ~F.col("has_event").between(0, 2),
}
PRICES = {
    "item_null": lambda: F.col("item_id").isNull(),
    "store_null": lambda: F.col("store_id").isNull(),
    "price_not_positive": lambda: F.col("sell_price") <= 0,
}


def members(rules: dict[str, object], **closed: list[str]) -> dict[str, object]:
    """The rules and one more for each column with a closed set of values, named <column>_unknown."""
    return rules | {f"{name}_unknown": (lambda name=name, values=values: ~F.col(name).isin(values)) for name, values in closed.items()}


def violations(rows: DataFrame, rules: dict[str, object]) -> DataFrame:
    """One row: n_rows and the number of rows that break each rule (an unknown test breaks none)."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.coalesce(rule(), F.lit(False))).alias(name) for name, rule in rules.items()))


def enforce(rows: DataFrame, rules: dict[str, object]) -> DataFrame:
    """The rows, failing the job at the first that breaks a rule; it costs no pass of its own."""
    ok: Column = F.lit(True)
    for rule in rules.values():
        ok = ok & ~F.coalesce(rule(), F.lit(False))
    return rows.withColumn("_ok", F.assert_true(ok, "a contract is broken")).filter(F.col("_ok").isNull()).drop("_ok")
