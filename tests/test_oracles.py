"""A handful of queries against their SQL on the smallest tables; the driver holds all of them against it."""

import collections

import duckdb
import pytest

from harvestline.plans.oracles import ORACLES
from harvestline.plans.learned import LEARNED
from harvestline.plans.queries import QUERIES as RETAIL
from harvestline.plans.stored import STORED

QUERIES = RETAIL | LEARNED | STORED

SF = "/root/testdata/sf0.001"
SOME = ["weekly_panel", "join_prices", "reconcile_mo", "score_models", "level_heatmap", "apply_fallback", "gate", "segments", "data_freshness", "upsert_points", "cv_summary", "feat_price", "seasonal_ma", "croston", "wrmsse", "accuracy_vs_actual", "drift_ks", "chunk_plan", "eda_pareto", "hist_quantile", "stream_rate", "dept_seasonal_ma", "feat_position", "contract_calendar", "contract_prices", "contract_members", "eda_pivot_revenue", "eda_season_weeks", "eda_corr_category", "eda_corr_store", "eda_describe", "eda_named_events", "level_bands", "active_runs", "future_rows", "future_calendar", "future_features", "fva_last_run", "gauges", "alerts", "assortment_churn", "acc_breakdowns", "run_segments", "run_drift_windows", "imapa", "counter_rates", "sustained_alerts", "stored_points", "memo_panel", "csv_calendar", "csv_prices", "csv_wide_sales", "slice_copy", "export_csv", "metric_files", "forecast_maturation", "eda_lorenz", "eda_describe_text", "labelled_gauges", "create_run", "fail_run", "chart_payload", "snap_or_zero", "contract_broken", "gate_stale", "contract_boost_features", "reconcile_eval"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(value):
    return round(value, 6) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    relation = duck.sql(ORACLES[name])
    assert sorted(relation.columns) == names
    at = [relation.columns.index(n) for n in names]
    want = collections.Counter(tuple(norm(r[i]) for i in at) for r in relation.fetchall())
    assert collections.Counter(tuple(norm(r[n]) for n in names) for r in df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
