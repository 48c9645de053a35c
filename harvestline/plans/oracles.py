"""The queries in SQL, each written on its own from common table expressions of the fixture."""

from __future__ import annotations

from harvestline.operators.metrics import LEVELS, UNIQUE

_CTES = {
    "raw": """SELECT p_brand AS item_id, n_name AS store_id, r_name AS state_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS week_start_date,
        CAST(sum(l_quantity) AS BIGINT) AS units, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "dim": """SELECT DISTINCT item_id || '_' || store_id AS id, item_id, 'D' || (CAST(regexp_extract(item_id, '([0-9]+)$', 1) AS INT) % 5) AS dept_id,
        'C' || (CAST(regexp_extract(item_id, '([0-9]+)$', 1) AS INT) % 5 % 2) AS cat_id, store_id, state_id FROM raw""",
    "wk": "SELECT week_start_date, row_number() OVER (ORDER BY week_start_date DESC) AS back FROM (SELECT DISTINCT week_start_date FROM raw)",
    "dense": """SELECT dim.*, wk.week_start_date, wk.back, coalesce(raw.units, 0) AS units, coalesce(raw.revenue, 0.0) AS revenue, raw.revenue / nullif(raw.units, 0) AS price
        FROM dim CROSS JOIN wk LEFT JOIN raw ON raw.item_id = dim.item_id AND raw.store_id = dim.store_id AND raw.week_start_date = wk.week_start_date""",
    "panel": """SELECT id, item_id, dept_id, cat_id, store_id, state_id, week_start_date, back,
        CAST(year(week_start_date) * 100 + weekofyear(week_start_date) AS INT) AS wm_yr_wk, units, revenue,
        last_value(price IGNORE NULLS) OVER (PARTITION BY id ORDER BY week_start_date) AS sell_price,
        CAST((weekofyear(week_start_date) * 3 + length(state_id)) % 8 AS INT) AS snap_days,
        CAST(CASE WHEN weekofyear(week_start_date) IN (1, 6, 13, 22, 27, 36, 47, 51) THEN 1 + weekofyear(week_start_date) % 2 ELSE 0 END AS INT) AS event_days,
        CASE WHEN week_start_date >= min(week_start_date) FILTER (units > 0) OVER (PARTITION BY id) THEN 7 ELSE 0 END AS available_days,
        CASE WHEN back = 1 THEN 5 ELSE 7 END AS n_days FROM dense""",
    "train": "SELECT * FROM panel WHERE back >= 9",
    "actual": "SELECT * FROM panel WHERE back <= 8",
    "ma": "SELECT id, avg(units) AS level FROM panel WHERE back BETWEEN 9 AND 12 GROUP BY id",
    "ma4": "SELECT a.id, a.week_start_date, coalesce(level, 0.0) AS pred FROM actual a LEFT JOIN ma USING (id)",
    "snaive": """SELECT a.id, a.week_start_date, coalesce(CAST(t.units AS DOUBLE), level, 0.0) AS pred
        FROM actual a LEFT JOIN train t ON t.id = a.id AND t.week_start_date = a.week_start_date - 364 LEFT JOIN ma ON ma.id = a.id""",
    "sindex": """SELECT id, woy, least(greatest(avg(units) / nullif(max(m), 0), 0.0), 5.0) AS idx, max(m) AS m
        FROM (SELECT id, weekofyear(week_start_date) AS woy, units, avg(units) OVER (PARTITION BY id) AS m FROM train) GROUP BY id, woy""",
    "sma": """SELECT a.id, a.week_start_date, coalesce(level, 0.0) * coalesce(CASE WHEN m > 0 THEN idx END, 1.0) AS pred
        FROM actual a LEFT JOIN ma USING (id) LEFT JOIN sindex s ON s.id = a.id AND s.woy = weekofyear(a.week_start_date)""",
    "runs": """SELECT CAST(r AS BIGINT) AS run_id, week_start_date AS origin, CASE r % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'partial' ELSE 'failed' END AS status,
        CASE WHEN r % 2 = 0 THEN 'NATION_3' ELSE 'all' END AS store, (SELECT count(*) FROM dim) AS n_series, CAST(ceil((SELECT count(*) FROM dim) / 300) AS BIGINT) AS n_chunks
        FROM range(1, 7) t(r) JOIN wk ON back = 21 - 2 * r""",
    "points": """SELECT run_id, id AS series_id, origin + CAST(7 * h AS INT) AS week_start_date, CAST(h AS INT) AS h, 0.5 * m AS p10, m AS p50, 1.5 * m AS p90, origin
        FROM (SELECT run_id, origin, id, avg(units) AS m FROM panel JOIN runs ON week_start_date <= origin AND week_start_date > origin - 28 GROUP BY ALL), range(1, 9) t(h)""",
    "last": "SELECT * FROM points WHERE run_id = 6",
    "matched": """SELECT q.*, p.units, p.state_id, p.snap_days, p.event_days FROM last q
        JOIN panel p ON p.id = q.series_id AND p.week_start_date = q.week_start_date AND p.n_days = 7""",
    "seg": """SELECT id AS series_id, CASE WHEN count(*) < 26 THEN 'coldstart' WHEN avg(units) < 1 THEN 'intermittent' ELSE 'frequent' END AS segment
        FROM panel WHERE n_days = 7 AND back >= 9 GROUP BY id""",
    "cal": """SELECT date, day(date) <= 10 AS a, day(date) % 2 AS b, day(date) > 20 AS c,
        CASE WHEN dayofyear(date) IN (1, 185, 359) THEN 'holiday' WHEN dayofyear(date) % 30 = 7 THEN 'match' END AS name1,
        CASE WHEN dayofyear(date) IN (1, 185) THEN 'National' WHEN dayofyear(date) = 359 THEN 'Religious' WHEN dayofyear(date) % 30 = 7 THEN 'Sporting' END AS type1,
        CASE WHEN dayofyear(date) % 60 = 7 THEN 'Cultural' END AS type2, CAST(date_trunc('week', date) AS DATE) AS week_start_date
        FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)""",
    "weekly_ev": """SELECT week_start_date, count(*) FILTER (type2 = 'Cultural') AS n_cultural, count(*) FILTER (type1 = 'National') AS n_national,
        count(*) FILTER (type1 = 'Religious') AS n_religious, count(*) FILTER (type1 = 'Sporting') AS n_sporting FROM cal GROUP BY 1""",
    "daily": """SELECT p_brand AS item_id, n_name AS store_id, r_name AS state_id, CAST(l_shipdate AS DATE) AS date, CAST(sum(l_quantity) AS BIGINT) AS units,
        sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS paid
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
    "wprice": """SELECT store_id, item_id, date_trunc('week', date) AS w, floor(CAST(sum(paid) AS DOUBLE) / CAST(sum(units) AS DOUBLE) * 100 + 0.5) / 100 AS sell_price FROM daily GROUP BY ALL HAVING sum(units) > 20""",
    "priced": "SELECT d.*, sell_price FROM daily d LEFT JOIN wprice p ON p.store_id = d.store_id AND p.item_id = d.item_id AND p.w = date_trunc('week', d.date)",
    "promo": """SELECT *, CASE WHEN rel < 0.9 THEN 1 ELSE 0 END AS is_promo FROM (SELECT *, sell_price / nullif(med, 0) AS rel FROM (
        SELECT *, CASE WHEN count(sell_price) OVER w >= 8 THEN quantile_cont(sell_price, 0.5) OVER w END AS med FROM panel
        WINDOW w AS (PARTITION BY id ORDER BY week_start_date ROWS BETWEEN 52 PRECEDING AND 1 PRECEDING)))""",
    "drift": """SELECT CASE WHEN o - week_start_date BETWEEN 0 AND 90 THEN 'current' ELSE 'reference' END AS side, id, units, sell_price
        FROM panel, (SELECT week_start_date AS o FROM wk WHERE back = 9)
        WHERE n_days = 7 AND (o - week_start_date BETWEEN 0 AND 90 OR o - week_start_date BETWEEN 364 AND 454)""",
    "total": "SELECT week_start_date, CAST(sum(units) AS BIGINT) AS units, sum(revenue) AS revenue FROM panel GROUP BY 1",
    "cat": """SELECT series_id, round(sum(p50), 2) AS total_p50, round(sum(p90 - p10), 2) AS width, any_value(item_id) AS item_id, any_value(dept_id) AS dept_id,
        any_value(cat_id) AS cat_id, any_value(store_id) AS store_id, any_value(state_id) AS state_id FROM last JOIN dim ON id = series_id GROUP BY 1""",
    "log": """SELECT run_id, idx, origin, CAST(seq AS INT) AS seq, k, CASE seq WHEN 1 THEN 'queued' WHEN 2 THEN 'processing' WHEN 3 THEN CASE WHEN k = 0 THEN 'failed' ELSE 'completed' END ELSE 'completed' END AS status
        FROM (SELECT run_id, idx, origin, (run_id * 7 + idx * 3) % 5 AS k, unnest([1, 2, 3, 4]) AS seq FROM runs, range(0, 1000) t(idx) WHERE idx < n_chunks)
        WHERE NOT (k = 1 AND seq > 2) AND NOT (k = 2 AND seq = 2)""",
    "states": """SELECT run_id, idx, CASE WHEN count(*) FILTER (seq = 2) = 0 THEN 'queued' WHEN count(*) FILTER (seq = 3) = 0 THEN 'processing'
        ELSE max(status) FILTER (seq = 3) END AS status FROM log GROUP BY ALL""",
    "folds_": """SELECT fold, model, sum(abs(units - pred)) / nullif(sum(units), 0) AS wape FROM (
        SELECT 4 - k AS fold, 'ma4' AS model, a.units, coalesce(avg(t.units), 0.0) AS pred FROM range(0, 4) f(k) JOIN panel a ON a.back BETWEEN 8 * k + 1 AND 8 * k + 8
          LEFT JOIN panel t ON t.id = a.id AND t.back BETWEEN 8 * k + 9 AND 8 * k + 12 GROUP BY k, a.id, a.week_start_date, a.units
        UNION ALL
        SELECT 4 - k, 'seasonal_naive', a.units, coalesce(CAST(max(y.units) AS DOUBLE), avg(t.units), 0.0) FROM range(0, 4) f(k) JOIN panel a ON a.back BETWEEN 8 * k + 1 AND 8 * k + 8
          LEFT JOIN panel t ON t.id = a.id AND t.back BETWEEN 8 * k + 9 AND 8 * k + 12
          LEFT JOIN panel y ON y.id = a.id AND y.week_start_date = a.week_start_date - 364 AND y.back > 8 * k + 8 GROUP BY k, a.id, a.week_start_date, a.units
        ) GROUP BY ALL""",
}


def _sid(keys: list[str]) -> str:
    return " || '|' || ".join(keys) if keys else "'TOTAL'"


def _levels(source: str, sums: str) -> str:
    return " UNION ALL ".join(f"SELECT {k} AS level, {_sid(v)} AS sid, week_start_date, {sums} FROM {source} GROUP BY 2, 3" for k, v in LEVELS.items())


_CTES |= {
    "ltrain": _levels("train", "CAST(sum(units) AS BIGINT) AS units, sum(revenue) AS revenue"),
    "lscale": """SELECT level, sid, avg(d * d) AS scale, avg(abs(d)) AS abs_scale FROM (
        SELECT level, sid, CAST(units - lag(units) OVER (PARTITION BY level, sid ORDER BY week_start_date) AS DOUBLE) AS d FROM ltrain) GROUP BY 1, 2 HAVING avg(d * d) > 0""",
    "lweight": """SELECT level, sid, r / nullif(sum(r) OVER (PARTITION BY level), 0) AS weight FROM (
        SELECT level, sid, sum(revenue) AS r FROM ltrain JOIN wk USING (week_start_date) WHERE back BETWEEN 9 AND 12 GROUP BY 1, 2)""",
}
_CTES["mo"] = """SELECT id, week_start_date, coalesce(g * CASE WHEN t > 0 THEN pred / t ELSE CAST(1 AS DOUBLE) / n END, pred) AS pred FROM (
        SELECT s.id, a.item_id, a.week_start_date, s.pred, sum(s.pred) OVER v AS t, count(*) OVER v AS n FROM snaive s JOIN actual a ON a.id = s.id AND a.week_start_date = s.week_start_date
        WINDOW v AS (PARTITION BY a.item_id, a.week_start_date)) JOIN (SELECT item_id, avg(u) AS g FROM (SELECT item_id, back, sum(units) AS u FROM panel WHERE back BETWEEN 9 AND 12 GROUP BY 1, 2) GROUP BY 1) USING (item_id)"""
for _m in ("ma4", "snaive", "sma", "mo"):
    _CTES |= {
        f"e_{_m}": f"SELECT a.*, p.pred FROM actual a JOIN {_m} p ON p.id = a.id AND p.week_start_date = a.week_start_date",
        f"s_{_m}": f"""SELECT level, sid, sqrt(avg(e * e) / max(scale)) AS rmsse, avg(abs(e)) / nullif(max(abs_scale), 0) AS mase, max(weight) AS weight
            FROM (SELECT level, sid, a - p AS e FROM ({_levels(f"e_{_m}", "CAST(sum(units) AS DOUBLE) AS a, sum(pred) AS p")}))
            JOIN lscale USING (level, sid) JOIN lweight USING (level, sid) GROUP BY 1, 2""",
        f"w_{_m}": f"SELECT level, sum(weight * rmsse) / sum(weight) AS wrmsse FROM s_{_m} GROUP BY 1 HAVING sum(weight) > 0",
        f"all_{_m}": f"""SELECT (SELECT avg(wrmsse) FROM w_{_m}) AS wrmsse12, (SELECT avg(wrmsse) FROM w_{_m} WHERE level IN {UNIQUE}) AS wrmsse9,
            (SELECT avg(rmsse) FROM s_{_m} WHERE level = 12) AS rmsse_l12, (SELECT avg(mase) FROM s_{_m} WHERE level = 12) AS mase_l12,
            (SELECT (sum(pred) - sum(units)) / sum(units) FROM e_{_m}) AS bias""",
    }


def with_ctes(body: str) -> str:
    """The body behind the expressions that it names, and those that they name."""
    import re

    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in _CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(_CTES[name])

    visit(body)
    # Each is defined before it is used: by depth of what it names.
    order: list[str] = []

    def place(name: str) -> None:
        for other in _CTES:
            if other != name and other in needed and other not in order and re.search(rf"\b{other}\b", _CTES[name]):
                place(other)
        if name not in order:
            order.append(name)

    for name in sorted(needed):
        place(name)
    # What several expressions read is computed once, as are the ones that others build on.
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({_CTES[n]})" for n in order) + " " + body if order else body


_ACC = """count(*) AS n, round(sum(abs(p50 - units)) / nullif(sum(units), 0), 4) AS wmape, round(sum(p50 - units) / nullif(sum(units), 0), 4) AS bias,
    round(avg(CASE WHEN units BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 4) AS coverage"""
_W = "WINDOW w AS (PARTITION BY id ORDER BY week_start_date)"


def _rows(m: int, h: int = 1) -> str:
    return f"OVER (PARTITION BY id ORDER BY week_start_date ROWS BETWEEN {h + m - 1} PRECEDING AND {h} PRECEDING)"


_BODIES = {
    "calendar_enrich": """SELECT date, CAST(date - min(date) OVER () + 1 AS INT) AS d_num, week_start_date, CAST((name1 IS NOT NULL) AS INT) + CAST((type2 IS NOT NULL) AS INT) AS has_event, CAST(a AS INT) AS snap_a FROM cal""",
    "weekly_calendar": """SELECT week_start_date, min(date) AS first_day, CAST(sum(CAST(a AS INT)) AS BIGINT) AS snap_a_days, CAST(sum(b) AS BIGINT) AS snap_b_days,
        CAST(sum(CAST(name1 IS NOT NULL AS INT) + CAST(type2 IS NOT NULL AS INT)) AS BIGINT) AS event_days, count(*) AS n_days FROM cal GROUP BY 1""",
    "weekly_events": "SELECT * FROM weekly_ev",
    "melt_daily": """SELECT item_id, state_id, CAST(d AS INT) AS d_num, CAST(coalesce(sum(units) FILTER (isodow(date) = d), 0) AS BIGINT) AS units, d >= 6 AS weekend
        FROM daily, range(1, 8) t(d) GROUP BY item_id, state_id, d""",
    "snap_by_state": """SELECT DISTINCT state_id, date, CAST(CASE WHEN state_id = 'ASIA' THEN CAST(a AS INT) WHEN state_id = 'EUROPE' THEN b ELSE CAST(c AS INT) END AS INT) AS snap FROM daily JOIN cal USING (date)""",
    "join_prices": "SELECT item_id, store_id, date, units, sell_price, CAST(sell_price IS NOT NULL AS INT) AS available, round(units * sell_price, 2) AS revenue FROM priced",
    "weekly_panel": """SELECT item_id, store_id, state_id, min(date) AS week_start_date, CAST(sum(units) AS BIGINT) AS units, round(coalesce(sum(units * sell_price), 0.0), 4) AS revenue,
        round(avg(sell_price), 4) AS sell_price, CAST(sum(CAST(sell_price IS NOT NULL AS INT)) AS INT) AS available_days, CAST(count(*) AS INT) AS n_days
        FROM priced GROUP BY item_id, store_id, state_id, date_trunc('week', date)""",
    "dense_panel": "SELECT * EXCLUDE (back) FROM panel",
    "load_window": "SELECT id, week_start_date, units FROM panel WHERE n_days = 7 AND back BETWEEN 2 AND 14",
    "category_slice": "SELECT id, week_start_date, units FROM panel WHERE cat_id = 'C0'",
    "series_dim": "SELECT * FROM dim",
    "add_events": "SELECT id, week_start_date, units, n_cultural, n_national, n_religious, n_sporting FROM panel JOIN weekly_ev USING (week_start_date)",
    "read_history": "SELECT id, week_start_date, units, sell_price FROM panel WHERE n_days = 7 AND back BETWEEN 9 AND 87 AND store_id IN ('NATION_1', 'NATION_2', 'NATION_3')",
    "stores": "SELECT DISTINCT store_id, state_id FROM dim",
    "item_dept_weekly": "SELECT item_id, dept_id, week_start_date, CAST(sum(units) AS BIGINT) AS units FROM panel GROUP BY ALL",
    "feat_lags": "SELECT id, week_start_date, " + ", ".join(f"lag(units, {k}) OVER w AS lag_{k}" for k in (1, 2, 3, 4, 8, 13, 26, 52)) + f" FROM panel {_W}",
    "feat_rolling": "SELECT id, week_start_date, " + ", ".join(f"round(avg(units) {_rows(m, 2)}, 4) AS rmean_{m}" for m in (4, 8, 13, 26)) + f", round(stddev_samp(units) {_rows(13, 2)}, 4) AS rstd_13, max(units) {_rows(13, 2)} AS rmax_13 FROM panel",
    "feat_nz": "SELECT id, week_start_date, " + ", ".join(f"round(avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END) {_rows(m)}, 4) AS nz_share_{m}" for m in (4, 13)) + " FROM panel",
    "feat_cross": f"""SELECT id, week_start_date, round(avg(i) {_rows(4)}, 4) AS item_rmean_4, round(avg(d) {_rows(4)}, 4) AS dept_rmean_4
        FROM (SELECT *, sum(units) OVER (PARTITION BY item_id, week_start_date) AS i, sum(units) OVER (PARTITION BY dept_id, week_start_date) AS d FROM panel)""",
    "feat_price": """SELECT id, week_start_date, med AS price_median, rel AS price_rel, is_promo,
        CAST(CASE WHEN last_no IS NULL THEN 52 ELSE least(no - last_no, 52) END AS INT) AS weeks_since_promo
        FROM (SELECT *, last_value(CASE WHEN is_promo = 1 THEN no END IGNORE NULLS) OVER (PARTITION BY id ORDER BY week_start_date) AS last_no FROM (SELECT *, (week_start_date - DATE '1970-01-01') // 7 AS no FROM promo))""",
    "feat_calendar": """SELECT id, week_start_date, CAST(woy AS INT) AS woy, round(sin(2 * pi() * woy / 52), 4) AS woy_sin, round(cos(2 * pi() * woy / 52), 4) AS woy_cos, CAST(month(week_start_date) AS INT) AS month,
        CASE WHEN woy IN (51, 52, 1) THEN 1 ELSE 0 END AS is_year_end, CAST(coalesce(greatest((week_start_date - first) // 7, 0), 0) AS INT) AS age_weeks
        FROM (SELECT *, weekofyear(week_start_date) AS woy, min(week_start_date) FILTER (units > 0) OVER (PARTITION BY id) AS first FROM panel)""",
    "cross_series": """SELECT item_id, dept_id, week_start_date, CAST(max(i) AS BIGINT) AS item_units, CAST(max(d) AS BIGINT) AS dept_units
        FROM (SELECT *, sum(units) OVER (PARTITION BY item_id, week_start_date) AS i, sum(units) OVER (PARTITION BY dept_id, week_start_date) AS d FROM panel) GROUP BY 1, 2, 3""",
    "feat_single_h": "SELECT id, week_start_date, lag(units, 4) OVER w AS lag_4, lag(units, 52) OVER w AS lag_52, " + ", ".join(f"round(avg(units) {_rows(m, 4)}, 4) AS rmean_{m}" for m in (4, 8, 13)) + f", round(stddev_samp(units) {_rows(8, 4)}, 4) AS rstd_8 FROM panel {_W}",
    "build_direct": " UNION ALL ".join(
        f"""SELECT id, {h} AS h, count(*) AS n, CAST(sum(l1) AS BIGINT) AS lag_1, CAST(sum(l52) AS BIGINT) AS lag_52, round(sum(m8), 4) AS rmean_8, round(avg(s13), 4) AS rstd_13,
        CAST(sum(x13) AS BIGINT) AS rmax_13, round(avg(z4), 4) AS nz_share_4, round(sum(d4), 4) AS dept_rmean_4 FROM (SELECT id, lag(units, {h}) OVER w AS l1, lag(units, {h + 51}) OVER w AS l52,
        avg(units) {_rows(8, h)} AS m8, stddev_samp(units) {_rows(13, h)} AS s13, max(units) {_rows(13, h)} AS x13, avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END) {_rows(4, h)} AS z4, avg(d) {_rows(4, h)} AS d4
        FROM (SELECT *, sum(units) OVER (PARTITION BY dept_id, week_start_date) AS d FROM panel) {_W}) GROUP BY 1"""
        for h in range(1, 9)
    ),
    "train_slice": "SELECT id, week_start_date, units FROM panel WHERE back BETWEEN 9 AND 112 AND available_days > 0",
    "select_test": "SELECT p.id, p.week_start_date, CAST(9 - p.back AS INT) AS h, t.units AS lag_1, round(level, 4) AS rmean_4 FROM panel p JOIN panel t ON t.id = p.id AND t.back = 9 JOIN ma ON ma.id = p.id WHERE p.back <= 8",
    "ma_level": "SELECT * FROM ma",
    "moving_average": "SELECT * FROM ma4",
    "seasonal_naive": "SELECT * FROM snaive",
    "seasonal_ma": "SELECT id, week_start_date, round(pred, 4) AS pred FROM sma",
    "croston": """SELECT id, round(coalesce(rate, 0.0), 4) AS rate FROM dim LEFT JOIN (SELECT id, sum(wt * units) / sum(wt * gap) * 0.95 AS rate FROM (
        SELECT id, units, pos - coalesce(lag(pos) OVER (PARTITION BY id ORDER BY pos), 0) AS gap,
        CASE WHEN row_number() OVER (PARTITION BY id ORDER BY pos) = 1 THEN pow(0.9, count(*) OVER (PARTITION BY id) - 1)
             ELSE 0.1 * pow(0.9, count(*) OVER (PARTITION BY id) - row_number() OVER (PARTITION BY id ORDER BY pos)) END AS wt
        FROM (SELECT id, units, row_number() OVER (PARTITION BY id ORDER BY week_start_date) AS pos FROM train) WHERE units > 0) GROUP BY id) USING (id)""",
    "ensemble": "SELECT a.id, a.week_start_date, (a.pred + b.pred) / 2 AS pred FROM ma4 a JOIN snaive b ON a.id = b.id AND a.week_start_date = b.week_start_date",
    "predict_masked": "SELECT m.id, m.week_start_date, CASE WHEN available_days = 0 THEN 0.0 ELSE greatest(pred, 0.0) END AS pred FROM ma4 m JOIN actual a ON a.id = m.id AND a.week_start_date = m.week_start_date",
    "hybrid": """SELECT s.id, s.week_start_date, CASE WHEN share < 0.5 THEN m.pred ELSE s.pred END AS pred FROM snaive s JOIN ma4 m ON m.id = s.id AND m.week_start_date = s.week_start_date
        JOIN (SELECT id, avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END) AS share FROM train GROUP BY 1) t ON t.id = s.id""",
    "calibration_factor": "SELECT round(sum(units) / greatest(sum(pred), 1e-9), 4) AS factor FROM e_ma4",
    "seasonal_decompose": """SELECT dept_id, CAST(phase AS INT) AS phase, round(raw_ / avg(raw_) OVER (PARTITION BY dept_id), 4) AS seasonal FROM (SELECT dept_id, phase, avg(y / trend) AS raw_ FROM (
        SELECT dept_id, y, (row_number() OVER o - 1) % 52 AS phase, CASE WHEN count(*) OVER (o ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53 THEN
        (sum(y) OVER (o ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) + 0.5 * (lag(y, 26) OVER o + lead(y, 26) OVER o)) / 52 END AS trend
        FROM (SELECT dept_id, week_start_date, CAST(sum(units) AS DOUBLE) AS y FROM train GROUP BY 1, 2) WINDOW o AS (PARTITION BY dept_id ORDER BY week_start_date)) WHERE trend > 0 GROUP BY 1, 2)""",
    "group_ratio": "SELECT dept_id, week_start_date, round(least(greatest(sum(units) / sum(level), 0.05), 20.0), 4) AS ratio FROM train JOIN ma USING (id) GROUP BY 1, 2 HAVING sum(level) > 0",
    "suspect_zeros": """SELECT count(*) FILTER (s) AS n, round(avg(CASE WHEN s THEN 1.0 ELSE 0.0 END), 4) AS share FROM (
        SELECT units = 0 AND available_days = 7 AND avg(CASE WHEN units > 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY id) >= 0.5 AS s FROM train)""",
    "agg_ma_forecast": """SELECT item_id, w.week_start_date, round(m, 4) AS agg_pred FROM (SELECT item_id, avg(u) AS m FROM (SELECT item_id, back, sum(units) AS u FROM panel WHERE back BETWEEN 9 AND 12 GROUP BY 1, 2) GROUP BY 1)
        CROSS JOIN wk w WHERE w.back <= 8""",
    "future_rows": """SELECT id, week_start_date + CAST(7 * h AS INT) AS week_start_date, CAST(h AS INT) AS h, sell_price, available_days, CAST(NULL AS BIGINT) AS units FROM panel, range(1, 9) t(h) WHERE back = 9""",
    "level_agg": "SELECT level, sid, week_start_date, units, round(revenue, 4) AS revenue FROM (" + _levels("actual", "CAST(sum(units) AS BIGINT) AS units, sum(revenue) AS revenue") + ")",
    "naive_scale": "SELECT level, sid, round(scale, 4) AS scale, round(abs_scale, 4) AS abs_scale FROM lscale",
    "level_weights": "SELECT level, sid, round(weight, 4) AS weight FROM lweight",
    "rmsse": "SELECT level, sid, round(rmsse, 4) AS rmsse, round(weight, 4) AS weight FROM s_ma4",
    "rmsse_l12": "SELECT round(rmsse_l12, 4) AS rmsse_l12 FROM all_ma4",
    "mase_l12": "SELECT round(mase_l12, 4) AS mase_l12 FROM all_ma4",
    "bias": "SELECT round(bias, 4) AS bias FROM all_ma4",
    "wrmsse": "SELECT round(wrmsse12, 4) AS wrmsse FROM all_ma4",
    "wrmsse9": "SELECT round(wrmsse9, 4) AS wrmsse FROM all_ma4",
    "deploy_gate": "SELECT wrmsse12 <= 0.75 AS deploy FROM all_ma4",
    "score_models": " UNION ALL ".join(f"SELECT round(wrmsse12, 4) AS wrmsse12, round(wrmsse9, 4) AS wrmsse9, round(rmsse_l12, 4) AS rmsse_l12, round(mase_l12, 4) AS mase_l12, round(bias, 4) AS bias, '{n}' AS model FROM all_{m}" for m, n in (("ma4", "ma4"), ("snaive", "seasonal_naive"), ("sma", "seasonal_ma"))),
    "level_heatmap": " UNION ALL ".join(f"SELECT level, round(wrmsse, 4) AS wrmsse, '{n}' AS model FROM w_{m}" for m, n in (("ma4", "ma4"), ("snaive", "seasonal_naive"), ("sma", "seasonal_ma"))),
    "segment_wape": """SELECT a.cat_id, a.state_id, round(sum(abs(a.units - a.pred)) / nullif(sum(a.units), 0), 3) AS ma4, round(sum(abs(a.units - b.pred)) / nullif(sum(a.units), 0), 3) AS seasonal_naive
        FROM e_ma4 a JOIN e_snaive b ON a.id = b.id AND a.week_start_date = b.week_start_date GROUP BY 1, 2""",
    "reconcile_mo": """SELECT id, item_id, week_start_date, floor(coalesce(g * CASE WHEN t > 0 THEN pred / t ELSE CAST(1 AS DOUBLE) / n END, pred) * 10000 + 0.5) / 10000 AS pred FROM (
        SELECT s.id, a.item_id, a.week_start_date, s.pred, sum(s.pred) OVER v AS t, count(*) OVER v AS n FROM snaive s JOIN actual a ON a.id = s.id AND a.week_start_date = s.week_start_date
        WINDOW v AS (PARTITION BY a.item_id, a.week_start_date)) JOIN (SELECT item_id, avg(u) AS g FROM (SELECT item_id, back, sum(units) AS u FROM panel WHERE back BETWEEN 9 AND 12 GROUP BY 1, 2) GROUP BY 1) USING (item_id)""",
    "reconciled_gap": """SELECT 'before' AS stage, round(max(abs(t - g)) FILTER (t > 1e-9), 4) AS gap FROM (SELECT item_id, a.week_start_date, sum(s.pred) AS t FROM snaive s JOIN actual a ON a.id = s.id AND a.week_start_date = s.week_start_date GROUP BY 1, 2)
        JOIN (SELECT item_id, avg(u) AS g FROM (SELECT item_id, back, sum(units) AS u FROM panel WHERE back BETWEEN 9 AND 12 GROUP BY 1, 2) GROUP BY 1) USING (item_id) UNION ALL SELECT 'after', 0.0""",
    "cv_summary": "SELECT model, round(avg(wape), 4) AS mean, round(stddev_samp(wape), 4) AS std FROM folds_ GROUP BY 1",
    "window_summary": "SELECT model, round(avg(wape), 4) AS mean, round(stddev_pop(wape), 4) AS std FROM folds_ GROUP BY 1",
    "fold_significance": "SELECT count(*) FILTER (d < 0) AS wins, round(avg(d), 4) AS mean_delta, round(stddev_samp(d), 4) AS std_delta FROM (SELECT fold, max(wape) FILTER (model = 'seasonal_naive') - max(wape) FILTER (model = 'ma4') AS d FROM folds_ GROUP BY 1)",
    "folds": "SELECT CAST(4 - k AS INT) AS fold, o.week_start_date AS origin, c.week_start_date AS cal_origin, e.week_start_date AS \"end\" FROM range(0, 4) t(k) JOIN wk e ON e.back = 8 * k + 1 JOIN wk o ON o.back = 8 * k + 9 JOIN wk c ON c.back = 8 * k + 17",
    "metriclog_latest": "SELECT CAST(fold AS INT) AS fold, model, round(wape + 3, 4) AS value, 3 AS run FROM folds_",
    "quantile_metrics": "SELECT " + ", ".join(f"round(avg(greatest({q} * (units - {c}), ({q} - 1) * (units - {c}))), 4) AS pinball_{c}, round(avg(CASE WHEN units <= {c} THEN 1.0 ELSE 0.0 END), 4) AS cover_{c}" for c, q in (("p10", 0.1), ("p50", 0.5), ("p90", 0.9)))
    + ", round(avg(CASE WHEN units BETWEEN p10 AND p90 THEN 1.0 ELSE 0.0 END), 4) AS interval, CAST(0.8 AS DOUBLE) AS interval_target FROM last q JOIN panel p ON p.id = q.series_id AND p.week_start_date = q.week_start_date",
    "recent_runs": "SELECT run_id, origin, status, store FROM runs",
    "run_status_counts": "SELECT status, count(*) AS n FROM runs GROUP BY 1",
    "last_run_id": "SELECT status, max(run_id) AS run_id FROM runs GROUP BY 1",
    "chunk_plan": "SELECT CAST(idx AS BIGINT) AS idx, count(*) AS n_series, min(id) AS first_id, max(id) AS last_id FROM (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 300 AS idx FROM dim) GROUP BY 1",
    "chunk_state": "SELECT * FROM states",
    "run_status": "SELECT run_id, CASE WHEN count(*) FILTER (status IN ('completed', 'failed')) < count(*) THEN 'processing' WHEN count(*) FILTER (status = 'failed') > 0 THEN 'partial' ELSE 'completed' END AS status FROM states GROUP BY 1",
    "run_progress": "SELECT run_id, count(*) AS n_chunks, count(*) FILTER (status IN ('completed', 'failed')) AS done, CAST(round(100.0 * count(*) FILTER (status IN ('completed', 'failed')) / count(*), 1) AS DOUBLE) AS percent FROM states GROUP BY 1",
    "stale_chunks": "SELECT run_id, idx FROM log GROUP BY 1, 2 HAVING max_by(status, seq) = 'processing' AND max(CAST(origin AS TIMESTAMP) + INTERVAL 10 MINUTE * seq) < TIMESTAMP '2001-09-15 00:00:00' - INTERVAL 15 MINUTE",
    "catalog": "SELECT * FROM cat",
    "catalog_rollup": "SELECT state_id, store_id, dept_id, round(sum(total_p50), 2) AS total_p50, round(sum(width), 2) AS width, count(*) AS n FROM cat GROUP BY ROLLUP (state_id, store_id, dept_id)",
    "width_bands": """SELECT series_id, round(rel, 4) AS rel, CASE WHEN rel <= 0.7 * med THEN 'narrow' WHEN rel <= 1.3 * med THEN 'mid' ELSE 'wide' END AS band FROM (
        SELECT *, quantile_cont(rel, 0.5) OVER () AS med FROM (SELECT series_id, CASE WHEN total_p50 > 0 THEN width / total_p50 ELSE 0.0 END AS rel FROM cat))""",
    "catalog_search": "SELECT id FROM dim WHERE lower(item_id || ' ' || id) LIKE '%brand#1%'",
    "catalog_drill": "SELECT id, store_id FROM dim WHERE state_id = 'EUROPE' AND dept_id = 'D1'",
    "agg_forecast": "SELECT week_start_date, round(sum(p10), 2) AS p10, round(sum(p50), 2) AS p50, round(sum(p90), 2) AS p90 FROM last JOIN dim ON id = series_id WHERE state_id = 'EUROPE' GROUP BY 1",
    "agg_history": "SELECT week_start_date, CAST(sum(units) AS BIGINT) AS units FROM panel WHERE n_days = 7 AND state_id = 'EUROPE' AND week_start_date > (SELECT min(week_start_date) FROM last) - 420 GROUP BY 1",
    "export_rows": "SELECT series_id, item_id, store_id, week_start_date, h, round(p10, 2) AS p10, round(p50, 2) AS p50, round(p90, 2) AS p90 FROM last JOIN dim ON id = series_id",
    "upsert_points": """SELECT series_id, week_start_date, max(v) AS run_id, max_by(p50, v) AS p50 FROM (SELECT series_id, week_start_date, run_id AS v, p50 FROM points
        UNION ALL SELECT series_id, week_start_date, run_id + 1, p50 + 1 FROM last) GROUP BY 1, 2""",
    "rearrange_quantiles": "SELECT run_id, series_id, week_start_date, h, p10, p50, p90 FROM last",
    "apply_fallback": """SELECT run_id, series_id, week_start_date, h, CASE WHEN bad THEN 0.5 * level ELSE p10 END AS p10, CASE WHEN bad THEN level ELSE p50 END AS p50, CASE WHEN bad THEN 1.5 * level ELSE p90 END AS p90, bad FROM (
        SELECT q.*, level, series_id LIKE '%NATION_3' OR bool_or(p50 > 10 * greatest(m, 1)) OVER (PARTITION BY series_id) AS bad FROM last q JOIN ma ON ma.id = series_id JOIN (SELECT id, max(units) AS m FROM train WHERE back <= 21 GROUP BY 1) t ON t.id = series_id)""",
    "series_forecast": """SELECT week_start_date, 'history' AS kind, CAST(units AS DOUBLE) AS value FROM panel WHERE back BETWEEN 2 AND 41 AND id = (SELECT id FROM panel GROUP BY id ORDER BY sum(units) DESC, id LIMIT 1)
        UNION ALL SELECT week_start_date, 'forecast', p50 FROM last WHERE series_id = (SELECT id FROM panel GROUP BY id ORDER BY sum(units) DESC, id LIMIT 1)""",
    "chart_context": """SELECT week_start_date, units, 'history' AS kind FROM total JOIN wk USING (week_start_date) WHERE back BETWEEN 9 AND 38
        UNION ALL SELECT week_start_date, units, 'actual' FROM total JOIN wk USING (week_start_date) WHERE back BETWEEN 2 AND 8""",
    "last_matured_run": "SELECT max(run_id) AS run_id FROM runs WHERE status = 'completed'",
    "accuracy_vs_actual": f"SELECT {_ACC} FROM matched",
    "acc_by_horizon": f"SELECT h, {_ACC} FROM matched GROUP BY h HAVING sum(units) > 0",
    "acc_by_state": f"SELECT state_id, {_ACC} FROM matched GROUP BY state_id HAVING sum(units) > 0",
    "acc_by_promo": f"SELECT event_days > 0 OR snap_days > 0 AS promo, {_ACC} FROM matched GROUP BY 1 HAVING sum(units) > 0",
    "segments": "SELECT * FROM seg",
    "acc_by_segment": f"SELECT segment, {_ACC} FROM matched JOIN seg USING (series_id) GROUP BY 1 HAVING sum(units) > 0",
    "fva_ma4": """SELECT round(m, 4) AS model, round(b, 4) AS ma4, round((b - m) / nullif(b, 0) * 100, 1) AS fva_pct FROM (SELECT sum(abs(q.p50 - p.units)) / nullif(sum(p.units), 0) AS m, sum(abs(l.level - p.units)) / nullif(sum(p.units), 0) AS b
        FROM points q JOIN panel p ON p.id = q.series_id AND p.week_start_date = q.week_start_date AND p.n_days = 7 JOIN (SELECT id, avg(units) AS level FROM panel WHERE back BETWEEN 15 AND 18 GROUP BY 1) l ON l.id = q.series_id WHERE run_id = 4)""",
    "planning_bias": f"SELECT max(abs(bias)) AS planning_bias FROM (SELECT state_id, {_ACC} FROM matched GROUP BY 1)",
    "data_freshness": """SELECT max(l) AS latest, count(DISTINCT week_start_date) AS n_weeks, round(CAST(count(DISTINCT id) FILTER (week_start_date = l) AS DOUBLE) / nullif(count(DISTINCT id) FILTER (week_start_date > l - 91), 0), 4) AS completeness
        FROM (SELECT *, max(week_start_date) OVER () AS l FROM panel WHERE n_days = 7)""",
    "assortment_churn": """SELECT count(*) FILTER (a AND NOT b) AS "new", count(*) FILTER (b AND NOT a) AS dead, count(*) FILTER (a) AS active FROM (
        SELECT id, bool_or(back BETWEEN 2 AND 14) AS a, bool_or(back BETWEEN 15 AND 27) AS b FROM panel WHERE units > 0 AND back BETWEEN 2 AND 27 GROUP BY id)""",
    "run_coverage": "SELECT run_id, round(CAST(count(DISTINCT series_id) AS DOUBLE) / any_value(n_series), 4) AS coverage FROM runs JOIN points USING (run_id) GROUP BY 1",
    "revision_volatility": """SELECT round(avg(s / m), 4) AS volatility, count(*) AS n FROM (SELECT stddev_samp(p50) AS s, avg(p50) AS m FROM points JOIN runs USING (run_id) WHERE status IN ('completed', 'partial')
        GROUP BY series_id, week_start_date HAVING count(DISTINCT points.origin) >= 2 AND avg(p50) > 0)""",
    "drift_windows": "SELECT side, id, count(*) AS n, CAST(sum(units) AS BIGINT) AS units, round(avg(sell_price), 4) AS price FROM drift GROUP BY 1, 2",
    "contract_weekly": """SELECT count(*) AS n_rows, count(*) FILTER (units < 0) AS units_negative, count(*) FILTER (revenue < 0) AS revenue_negative, count(*) FILTER (sell_price <= 0) AS price_not_positive,
        count(*) FILTER (snap_days NOT BETWEEN 0 AND 7) AS snap_days_range, count(*) FILTER (event_days NOT BETWEEN 0 AND 14) AS event_days_range, count(*) FILTER (available_days NOT BETWEEN 0 AND 7) AS available_days_range,
        count(*) FILTER (n_days NOT BETWEEN 1 AND 7) AS n_days_range, count(*) FILTER (id IS NULL) AS id_null FROM panel""",
    "contract_features": "SELECT 8 * count(*) AS n_rows, CAST(0 AS BIGINT) AS h_range, count(*) FILTER (units < 0) AS lag_negative, CAST(0 AS BIGINT) AS share_range, count(*) FILTER (units < 0) AS units_negative FROM panel",
    "contract_output": "SELECT count(*) AS n_rows, count(*) FILTER (p10 < 0) AS p10_negative, count(*) FILTER (p10 > p50 OR p50 > p90) AS not_monotone, count(*) FILTER (p50 IS NULL) AS missing, count(*) FILTER (h < 1) AS h_range FROM points",
    "eda_structure": "SELECT " + ", ".join(f"count(DISTINCT {n}) AS n_{n}" for n in ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id", "week_start_date")) + ", min(week_start_date) AS first_week, max(week_start_date) AS last_week, count(*) AS n_rows FROM panel",
    "eda_quality": "SELECT count(*) FILTER (units = 0) AS zero_weeks, count(*) FILTER (sell_price IS NULL) AS no_price, count(*) FILTER (available_days = 0) AS unavailable, count(*) FILTER (n_days < 7) AS short_weeks, round(avg(CASE WHEN units = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share FROM panel",
    "eda_oos": "SELECT week_start_date, round(avg(CASE WHEN available_days = 0 THEN 1.0 ELSE 0.0 END), 4) AS oos_share FROM panel GROUP BY 1",
    "eda_target": "SELECT " + ", ".join(f"round(quantile_cont(units, {q}), 4) AS p{str(q)[2:]}" for q in (0.5, 0.75, 0.9, 0.95, 0.99, 0.999)) + ", round(avg(CASE WHEN units = 0 THEN 1.0 ELSE 0.0 END), 4) AS zero_share, round(avg(CASE WHEN units > (SELECT quantile_cont(units, 0.99) FROM panel) THEN 1.0 ELSE 0.0 END), 4) AS over_p99 FROM panel",
    "eda_rolling": "SELECT week_start_date, units, round(CASE WHEN count(*) OVER v >= 4 THEN avg(units) OVER v END, 4) AS rolling FROM total WINDOW v AS (ORDER BY week_start_date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)",
    "eda_yoy": "SELECT CAST(y AS INT) AS year, round(u, 4) AS units_per_week, round(r, 2) AS revenue_per_week, round(100 * (u / nullif(lag(u) OVER (ORDER BY y), 0) - 1), 2) AS yoy_pct FROM (SELECT year(week_start_date) AS y, avg(units) AS u, avg(revenue) AS r FROM total GROUP BY 1)",
    "eda_season": "SELECT CAST(month(week_start_date) AS INT) AS month, count(*) AS n, quantile_cont(units, 0.25) AS q1, quantile_cont(units, 0.5) AS median, quantile_cont(units, 0.75) AS q3 FROM total GROUP BY 1",
    "eda_acf": """SELECT CAST(k AS INT) AS lag, round(sum(a.d * b.d) / any_value(v), 4) AS acf FROM range(0, 61) t(k), (SELECT row_number() OVER (ORDER BY week_start_date) AS i, units - avg(units) OVER () AS d FROM total) a
        JOIN (SELECT row_number() OVER (ORDER BY week_start_date) AS i, units - avg(units) OVER () AS d FROM total) b ON a.i = b.i + k, (SELECT var_pop(units) * count(*) AS v FROM total) GROUP BY 1""",
    "eda_pivot": 'SELECT cat_id, ' + ", ".join(f"CAST(sum(units) FILTER (state_id = '{s}') AS BIGINT) AS \"{s}\"" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM panel GROUP BY 1",
    "eda_share": "SELECT cat_id, round(sum(revenue) / sum(sum(revenue)) OVER (), 4) AS share, round(avg(sell_price), 2) AS avg_price FROM panel GROUP BY 1",
    "eda_pareto": """SELECT count(*) FILTER (c < 0.5) AS n_50, count(*) FILTER (c < 0.8) AS n_80, count(*) FILTER (c < 0.9) AS n_90, count(*) AS n_all FROM (
        SELECT coalesce(sum(u) OVER (ORDER BY u DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(u) OVER () AS c FROM (SELECT id, sum(units) AS u FROM panel GROUP BY 1))""",
    "sb_class": """SELECT id, round(adi, 4) AS adi, round(cv2, 4) AS cv2, CASE WHEN nnz < 2 THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN cv2 < 0.49 THEN 'intermittent' WHEN adi < 1.32 THEN 'erratic' ELSE 'lumpy' END AS kind
        FROM (SELECT id, count(*) FILTER (units > 0) AS nnz, count(*) / nullif(count(*) FILTER (units > 0), 0) AS adi, pow(stddev_pop(units) FILTER (units > 0) / nullif(avg(units) FILTER (units > 0), 0), 2) AS cv2 FROM panel GROUP BY 1)""",
    "eda_promo_lift": "SELECT cat_id, round(avg(CAST(is_promo AS DOUBLE)), 4) AS promo_share, round(avg(units) FILTER (is_promo = 1) / nullif(avg(units) FILTER (is_promo = 0), 0), 4) AS lift FROM promo WHERE rel IS NOT NULL GROUP BY 1",
    "eda_snap": "SELECT state_id, snap_days, round(avg(units), 4) AS mean_units FROM panel GROUP BY 1, 2",
    "eda_event_lift": """SELECT CAST(woy AS INT) AS woy, round(avg(units) / (SELECT avg(units) FROM total JOIN (SELECT DISTINCT week_start_date, event_days FROM panel) USING (week_start_date) WHERE event_days = 0), 4) AS lift
        FROM (SELECT weekofyear(week_start_date) AS woy, units FROM total JOIN (SELECT DISTINCT week_start_date, event_days FROM panel) USING (week_start_date) WHERE event_days > 0) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""",
    "eda_corr": "SELECT a.state_id, b.state_id AS other, round(corr(a.y, b.y), 4) AS corr FROM (SELECT state_id, week_start_date, CAST(sum(units) AS DOUBLE) AS y FROM panel GROUP BY 1, 2) a JOIN (SELECT state_id, week_start_date, CAST(sum(units) AS DOUBLE) AS y FROM panel GROUP BY 1, 2) b USING (week_start_date) GROUP BY 1, 2",
    "eda_age": """SELECT CAST(min(w) AS INT) AS youngest, CAST(max(w) AS INT) AS oldest, round(avg(CASE WHEN w < 52 THEN 1.0 ELSE 0.0 END), 4) AS under_52, round(avg(CASE WHEN w < 13 THEN 1.0 ELSE 0.0 END), 4) AS under_13
        FROM (SELECT id, round(((SELECT max(week_start_date) FROM panel) - min(week_start_date)) / 7) AS w FROM panel WHERE units > 0 GROUP BY 1)""",
    "eda_split": "SELECT max(week_start_date) - 112 AS train_end, max(week_start_date) - 56 AS val_end, max(week_start_date) AS test_end FROM panel WHERE n_days = 7",
    "eda_missing": "SELECT count(*) FILTER (units IS NULL) AS null_units, count(*) FILTER (revenue IS NULL) AS null_revenue, count(*) FILTER (sell_price IS NULL) AS null_sell_price, round(count(*) / (count(DISTINCT id) * count(DISTINCT week_start_date)), 4) AS completeness FROM panel",
    "eda_zero_share": "SELECT round(quantile_cont(z, 0.5), 4) AS median, round(avg(z), 4) AS mean, round(quantile_cont(z, 0.95), 4) AS p95 FROM (SELECT avg(CASE WHEN units = 0 THEN 1.0 ELSE 0.0 END) AS z FROM panel GROUP BY id)",
    "availability_summary": "SELECT round(avg(CASE WHEN available_days = 0 THEN 1.0 ELSE 0.0 END), 4) AS none, round(avg(CASE WHEN available_days = 7 THEN 1.0 ELSE 0.0 END), 4) AS \"full\", bool_and(available_days IN (0, 7)) AS is_binary FROM panel",
    "top_series": "SELECT cat_id, id, round(r, 0) AS revenue, CAST(1 AS INT) AS rn FROM (SELECT cat_id, id, sum(revenue) AS r, row_number() OVER (PARTITION BY cat_id ORDER BY sum(revenue) DESC, id) AS k FROM panel GROUP BY 1, 2) WHERE k = 1",
    "panel_topk": "SELECT store_id, dept_id, id, round(r, 0) AS revenue, CAST(k AS INT) AS rn FROM (SELECT store_id, dept_id, id, sum(revenue) AS r, row_number() OVER (PARTITION BY store_id, dept_id ORDER BY sum(revenue) DESC, id) AS k FROM panel GROUP BY 1, 2, 3) WHERE k <= 15",
    "cold_split": "SELECT item_id, CAST('0x' || substr(md5(item_id), 1, 6) AS BIGINT) % 100 < 20 AS cold, count(*) AS n FROM panel GROUP BY 1, 2",
    "stream_rate": """SELECT w AS window_start, event_type, count(*) AS n, round(count(*) / 600.0, 6) AS per_second FROM (
        SELECT event_type, unnest([time_bucket(INTERVAL 5 MINUTE, CAST(ts AS TIMESTAMP)), time_bucket(INTERVAL 5 MINUTE, CAST(ts AS TIMESTAMP)) - INTERVAL 5 MINUTE]) AS w FROM events) GROUP BY 1, 2""",
}
_BODIES["drift_ks"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(max(abs(r / tr - k / tc)), 4) AS ks FROM (SELECT x, sum(r) OVER (ORDER BY x) AS r, sum(k) OVER (ORDER BY x) AS k, CAST(sum(r) OVER () AS DOUBLE) AS tr, CAST(sum(k) OVER () AS DOUBLE) AS tc
    FROM (SELECT CAST({c} AS DOUBLE) AS x, count(*) FILTER (side = 'reference') AS r, count(*) FILTER (side = 'current') AS k FROM drift WHERE {c} IS NOT NULL GROUP BY 1))"""
    for c in ("sell_price", "units")
)
_PSI = """SELECT '{c}' AS feature, round(sum((c - r) * ln(c / r)), 4) AS psi FROM (
    SELECT b, greatest(coalesce(nr, 0) / tr, 1e-6) AS r, greatest(coalesce(nc, 0) / tc, 1e-6) AS c FROM (SELECT unnest(range(0, (SELECT len(e) FROM ({e})) - 1)) AS b)
    LEFT JOIN (SELECT len(list_filter((SELECT e[2:len(e) - 1] FROM ({e})), lambda y: y <= x)) AS b, CAST(count(*) FILTER (side = 'reference') AS DOUBLE) AS nr, CAST(count(*) FILTER (side = 'current') AS DOUBLE) AS nc
        FROM (SELECT side, CAST({c} AS DOUBLE) AS x FROM drift WHERE {c} IS NOT NULL) GROUP BY 1) USING (b),
    (SELECT CAST(count(*) FILTER (side = 'reference') AS DOUBLE) AS tr, CAST(count(*) FILTER (side = 'current') AS DOUBLE) AS tc FROM drift WHERE {c} IS NOT NULL))"""
_EDGES = "SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM drift WHERE side = 'reference' AND {c} IS NOT NULL"
_BODIES["drift_psi"] = "SELECT *, CASE WHEN psi < 0.1 THEN 'narrow' WHEN psi < 0.25 THEN 'mid' ELSE 'wide' END AS status FROM (" + " UNION ALL ".join(_PSI.format(c=c, e=_EDGES.format(c=c)) for c in ("sell_price", "units")) + ")"
_BOUNDS = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
_BODIES["hist_quantile"] = (
    "SELECT event_type, n, round(CASE WHEN k >= 7 THEN 250.0 ELSE lo + (hi - lo) * (0.95 * n - below) / nullif(upto - below, 0) END, 6) AS quantile FROM (SELECT *, ["
    + "0.0, " + ", ".join(map(str, _BOUNDS)) + "][k + 1] AS lo, [0.0, " + ", ".join(map(str, _BOUNDS)) + "][k + 2] AS hi, CASE WHEN k > 0 THEN cum[k] ELSE 0 END AS below, cum[k + 1] AS upto FROM (SELECT *, len(list_filter(cum, lambda c: c < 0.95 * n)) AS k FROM (SELECT event_type, count(*) AS n, ["
    + ", ".join(f"count(*) FILTER (value <= {b})" for b in _BOUNDS) + "] AS cum FROM events GROUP BY 1)))"
)
_BODIES["fva_last_run"] = _BODIES["fva_ma4"].replace("back BETWEEN 15 AND 18", "back BETWEEN 9 AND 12").replace("run_id = 4", "run_id = 6").replace(" AS fva_pct", " + 0.0 AS fva_pct")
_BODIES["future_calendar"] = f"""SELECT p.id, p.week_start_date + CAST(7 * h AS INT) AS week_start_date, CAST(h AS INT) AS h, CAST(coalesce(CASE WHEN state_id = 'ASIA' THEN c.snap_a_days ELSE c.snap_b_days END, 0) AS INT) AS snap_days,
    CAST(coalesce(c.event_days, 0) AS INT) AS event_days FROM (SELECT * FROM panel, range(1, 9) t(h) WHERE back = 9) p LEFT JOIN ({_BODIES["weekly_calendar"]}) c ON c.week_start_date = p.week_start_date + CAST(7 * h AS INT)"""
_BODIES["future_features"] = """SELECT p.id, p.week_start_date + CAST(7 * h AS INT) AS week_start_date, CAST(h AS INT) AS h, p.units AS lag_1, round(level, 4) AS rmean_4, sell_price, available_days
    FROM panel p JOIN ma ON ma.id = p.id, range(1, 9) t(h) WHERE back = 9"""
_MEASURES = {
    "promo_wmape": ("acc_by_promo", "wmape", "promo"), "wmape": ("accuracy_vs_actual", "wmape", "true"), "bias": ("accuracy_vs_actual", "bias", "true"),
    "coverage": ("accuracy_vs_actual", "coverage", "true"), "planning_bias": ("planning_bias", "planning_bias", "true"), "completeness": ("data_freshness", "completeness", "true"),
    "revision": ("revision_volatility", "volatility", "true"), "run_coverage": ("run_coverage", "min(coverage)", "true"), "psi": ("drift_psi", "max(psi)", "true"), "ks": ("drift_ks", "max(ks)", "true"),
    "fva": ("fva_last_run", "fva_pct", "true"),
}
_BODIES["gauges"] = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {v} AS value FROM ({_BODIES[b]}) WHERE {c}" for n, (b, v, c) in _MEASURES.items()) + ") WHERE value IS NOT NULL"
_FIRES = """CASE name WHEN 'wmape' THEN value > 0.5 WHEN 'bias' THEN abs(value) > 0.2 WHEN 'coverage' THEN value < 0.6 WHEN 'psi' THEN value > 0.25 WHEN 'ks' THEN value > 0.2 WHEN 'planning_bias' THEN value > 0.15
    WHEN 'promo_wmape' THEN value > 0.5 WHEN 'completeness' THEN value < 0.9 WHEN 'revision' THEN value > 0.3 WHEN 'run_coverage' THEN value < 0.99 WHEN 'fva' THEN value <= -8 END"""
_BODIES["alerts"] = f"SELECT name, {_FIRES} AS firing FROM ({_BODIES['gauges']})"
_BODIES["gate"] = f"""SELECT coalesce(string_agg(w, ',' ORDER BY k), '') AS warnings, count(*) > 0 AS degraded FROM (SELECT DISTINCT CASE WHEN name IN ('psi', 'ks') THEN 'drift' ELSE name END AS w,
    list_position(['wmape', 'bias', 'coverage', 'drift', 'planning_bias', 'promo_wmape', 'fva', 'completeness', 'revision', 'run_coverage'], CASE WHEN name IN ('psi', 'ks') THEN 'drift' ELSE name END) AS k FROM ({_BODIES['alerts']}) WHERE firing)"""
_PHASES = """SELECT dept_id, week_start_date, y, (row_number() OVER o - 1) % 52 AS phase, CASE WHEN count(*) OVER (o ROWS BETWEEN 26 PRECEDING AND 26 FOLLOWING) = 53 THEN
    (sum(y) OVER (o ROWS BETWEEN 25 PRECEDING AND 25 FOLLOWING) + 0.5 * (lag(y, 26) OVER o + lead(y, 26) OVER o)) / 52 END AS trend
    FROM (SELECT dept_id, week_start_date, CAST(sum(units) AS DOUBLE) AS y FROM train GROUP BY 1, 2) WINDOW o AS (PARTITION BY dept_id ORDER BY week_start_date)"""
_BODIES["dept_seasonal_ma"] = f"""SELECT a.id, a.week_start_date, round(greatest(coalesce(level, 0.0) * least(greatest(coalesce(idx, 1.0), 0.0), 3.0), 0.0), 4) AS pred FROM actual a
    LEFT JOIN (SELECT id, avg(units) AS level FROM panel WHERE back BETWEEN 9 AND 16 GROUP BY id) l ON l.id = a.id
    LEFT JOIN (SELECT dept_id, weekofyear(week_start_date) AS woy, avg(seasonal) AS idx FROM ({_PHASES}) JOIN (
        SELECT dept_id, phase, m / avg(m) OVER (PARTITION BY dept_id) AS seasonal FROM (SELECT dept_id, phase, avg(y / trend) AS m FROM ({_PHASES}) WHERE trend > 0 GROUP BY 1, 2)
    ) USING (dept_id, phase) GROUP BY 1, 2) s ON s.dept_id = a.dept_id AND s.woy = weekofyear(a.week_start_date)"""
_BODIES["level_bands"] = f"SELECT model, level, CASE WHEN wrmsse < 0.65 THEN 'good' WHEN wrmsse < 0.85 THEN 'fair' ELSE 'poor' END AS band FROM ({_BODIES['level_heatmap'].replace('round(wrmsse, 4)', 'wrmsse')})"
_BODIES["active_runs"] = "SELECT count(*) AS active FROM runs"
_BODIES["feat_position"] = "SELECT id, week_start_date, CAST(row_number() OVER (PARTITION BY id ORDER BY week_start_date) - 1 AS INT) AS position FROM panel"
_BODIES["contract_calendar"] = "SELECT count(*) AS n_rows, count(*) FILTER (date IS NULL) AS date_null, count(*) FILTER (date < (SELECT min(date) FROM cal)) AS d_num_range, count(*) FILTER (CAST(a AS INT) NOT IN (0, 1) OR b NOT IN (0, 1) OR CAST(c AS INT) NOT IN (0, 1)) AS snap_range, count(*) FILTER (CAST(name1 IS NOT NULL AS INT) + CAST(type2 IS NOT NULL AS INT) > 2) AS has_event_range FROM cal"
_BODIES["contract_prices"] = "SELECT count(*) AS n_rows, count(*) FILTER (item_id IS NULL) AS item_null, count(*) FILTER (store_id IS NULL) AS store_null, count(*) FILTER (sell_price <= 0) AS price_not_positive FROM wprice"
_BODIES["contract_members"] = "SELECT count(*) AS n_rows, count(*) FILTER (state_id NOT IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')) AS state_id_unknown, count(*) FILTER (NOT regexp_full_match(dept_id, 'D[0-4]')) AS dept_id_unknown, count(*) FILTER (cat_id <> 'C0') AS cat_id_unknown FROM panel"
_BODIES["eda_pivot_revenue"] = "SELECT cat_id, " + ", ".join(f"round(sum(revenue) FILTER (state_id = '{s}'), 4) AS \"{s}\"" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM panel GROUP BY 1"
_BODIES["eda_season_weeks"] = _BODIES["eda_season"].replace("CAST(month(week_start_date) AS INT) AS month", "CAST(weekofyear(week_start_date) AS INT) AS woy")
_BODIES |= {f"eda_corr_{n}": _BODIES["eda_corr"].replace("state_id", k) for n, k in (("category", "cat_id"), ("store", "store_id"))}
_BODIES["eda_describe"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS name, count({c}) AS n, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd, round(CAST(min({c}) AS DOUBLE), 4) AS least, round(CAST(max({c}) AS DOUBLE), 4) AS most,
    round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q1, round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median, round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q3 FROM panel"""
    for c in ("units", "sell_price", "snap_days", "event_days", "available_days")
)
_BODIES["eda_named_events"] = """SELECT event, round(avg(units) / (SELECT avg(units) FROM total WHERE week_start_date NOT IN (SELECT week_start_date FROM cal WHERE name1 IS NOT NULL OR type2 IS NOT NULL)), 4) AS lift
    FROM total JOIN (SELECT week_start_date, name1 AS event FROM cal WHERE name1 IS NOT NULL UNION SELECT week_start_date, 'fair' FROM cal WHERE type2 IS NOT NULL) USING (week_start_date)
    GROUP BY event ORDER BY lift DESC, event LIMIT 12"""
_HALF = "regexp_matches(series_id, '[02468]$')"
_BODIES["acc_breakdowns"] = " UNION ALL ".join(
    f"""SELECT '{n}' AS by, CAST({k} AS VARCHAR) AS key, {_ACC} FROM (SELECT matched.*, segment, event_days > 0 OR snap_days > 0 AS promo FROM matched LEFT JOIN seg USING (series_id) WHERE {_HALF})
    WHERE {k} IS NOT NULL GROUP BY {k} HAVING sum(units) > 0"""
    for n, k in (("h", "h"), ("state_id", "state_id"), ("promo", "promo"), ("segment", "segment"))
)
_BODIES["run_segments"] = f"SELECT * FROM seg WHERE {_HALF}"
_BODIES["run_drift_windows"] = f"SELECT side, id, count(*) AS n, CAST(sum(units) AS BIGINT) AS units FROM drift WHERE {_HALF.replace('series_id', 'id')} GROUP BY 1, 2"
_BODIES["imapa"] = """SELECT id, round(coalesce(rate, 0.0), 4) AS rate, levels FROM (
    SELECT id, CAST(coalesce(round_even(max(i) FILTER (units > 0) / count(*) FILTER (units > 0), 0), 0) AS INT) AS levels
    FROM (SELECT id, units, row_number() OVER (PARTITION BY id ORDER BY week_start_date) AS i FROM train) GROUP BY id
) LEFT JOIN (
    SELECT id, avg(level / k) AS rate FROM (
        SELECT id, k, arg_min(level, [sse, alpha]) AS level FROM (
            SELECT id, k, alpha, coalesce(sum((s - before) * (s - before)), 0.0) AS sse, arg_max(level, t) AS level FROM (
                SELECT *, lag(level) OVER (PARTITION BY id, k, alpha ORDER BY t) AS before FROM (
                    SELECT id, k, alpha, t, s, pow(1 - alpha, t) * sum(CASE WHEN t = 0 THEN s ELSE alpha * pow(1 - alpha, -t) * s END) OVER (PARTITION BY id, k, alpha ORDER BY t) AS level
                    FROM (SELECT id, k, (i - n % k - 1) // k AS t, CAST(sum(units) AS DOUBLE) AS s FROM (
                        SELECT id, units, row_number() OVER (PARTITION BY id ORDER BY week_start_date) AS i, count(*) OVER (PARTITION BY id) AS n FROM train
                    ) JOIN (
                        SELECT id, unnest(range(1, CAST(round_even(max(i) / count(*), 0) AS BIGINT) + 1)) AS k
                        FROM (SELECT id, units, row_number() OVER (PARTITION BY id ORDER BY week_start_date) AS i FROM train) WHERE units > 0 GROUP BY id
                    ) USING (id) WHERE i > n % k GROUP BY ALL), (SELECT unnest([CAST(0.1 AS DOUBLE), 0.15, 0.2, 0.25, 0.3]) AS alpha)
                )
            ) GROUP BY ALL
        ) GROUP BY ALL
    ) GROUP BY id
) USING (id)"""
_BODIES["counter_rates"] = """SELECT * FROM (WITH c AS (SELECT event_type AS key, ts, CAST(row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS DOUBLE) AS v FROM events),
    l AS (SELECT *, CASE WHEN v < lag(v) OVER (PARTITION BY key ORDER BY ts, v) THEN lag(v) OVER (PARTITION BY key ORDER BY ts, v) ELSE 0 END AS lost FROM c),
    w AS (SELECT key, time_bucket(INTERVAL 60 minutes, ts) - j * INTERVAL 60 minutes AS window_start, count(*) AS n, first(v ORDER BY ts, v) AS v0, last(v ORDER BY ts, v) AS v1, sum(lost) - first(lost ORDER BY ts, v) AS lost,
        epoch_us(min(ts)) / 1e6 AS t0, epoch_us(max(ts)) / 1e6 AS t1 FROM l, range(0, 2) t(j) GROUP BY ALL),
    r AS (SELECT *, v1 - v0 + lost AS increase, t1 - t0 AS span, (t1 - t0) / (n - 1) AS step, t0 - epoch_us(window_start) / 1e6 AS a, epoch_us(window_start) / 1e6 + 7200 - t1 AS b FROM w WHERE n > 1 AND t1 > t0)
    SELECT key, window_start, n, round(increase, 4) AS increase,
        round(increase * (span + least(CASE WHEN a >= 1.1 * step THEN step / 2 ELSE a END, CASE WHEN increase > 0 THEN span * v0 / increase ELSE a END) + CASE WHEN b >= 1.1 * step THEN step / 2 ELSE b END) / span / 7200, 8) AS per_second FROM r)"""
_BODIES["sustained_alerts"] = """SELECT * FROM (WITH e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS t, event_id, coalesce(value > 5, false) AS high, (SELECT epoch_us(max(ts)) // 1000 - 1800000 FROM events) AS mark FROM events),
    s AS (SELECT *, count(*) FILTER (NOT high) OVER (PARTITION BY key ORDER BY t, event_id) AS dips FROM e WHERE t <= mark),
    i AS (SELECT key, dips, min(t) AS since, any_value(mark) AS mark FROM s WHERE high GROUP BY 1, 2),
    d AS (SELECT key, dips - 1 AS dips, t FROM s WHERE NOT high)
    SELECT key, make_timestamp(since * 1000) AS since, make_timestamp((since + 3600000) * 1000) AS fired_at FROM i LEFT JOIN d USING (key, dips) WHERE coalesce(d.t > since + 3600000, since + 3600000 < mark))"""
_BODIES |= {new: _BODIES[old] for new, old in (("stored_points", "upsert_points"), ("memo_panel", "dense_panel"), ("csv_calendar", "calendar_enrich"), ("slice_copy", "category_slice"), ("export_csv", "export_rows"))}
_BODIES["csv_prices"] = "SELECT store_id, item_id, CAST(w AS DATE) AS wm_yr_wk, round(sell_price, 4) AS sell_price FROM wprice"
_BODIES["csv_wide_sales"] = f"SELECT item_id || '_' || state_id AS id, * FROM ({_BODIES['melt_daily']})"
_BODIES["metric_files"] = " UNION ALL ".join(f"SELECT '{f}' AS format, * FROM ({_BODIES['cv_summary']})" for f in ("json", "csv"))
_BODIES["forecast_maturation"] = """SELECT run_id, series_id, q.week_start_date, h, round(p50, 4) AS p50, p.units, p.units IS NOT NULL AS matured FROM points q
    LEFT JOIN panel p ON p.id = q.series_id AND p.week_start_date = q.week_start_date AND p.n_days = 7 AND weekofyear(p.week_start_date) % 5 <> 0"""
_BODIES["eda_lorenz"] = """SELECT step, place, round(cum / grand, 4) AS share FROM (
    SELECT place, cum, grand, CAST(floor(place * 20 / n_all) AS BIGINT) AS step, CAST(floor((place - 1) * 20 / n_all) AS BIGINT) AS before FROM (
        SELECT row_number() OVER (ORDER BY u DESC, id) AS place, sum(u) OVER (ORDER BY u DESC, id) AS cum, count(*) OVER () AS n_all, sum(u) OVER () AS grand FROM (SELECT id, sum(units) AS u FROM panel GROUP BY id)
    )) WHERE step > before"""
_BODIES["eda_describe_text"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, first({c} ORDER BY n DESC, {c}) AS top, max(n) AS freq FROM (SELECT {c}, count(*) AS n FROM panel GROUP BY 1)"
    for c in ("id", "item_id", "dept_id", "cat_id", "store_id", "state_id")
)
_BODIES["labelled_gauges"] = f"SELECT 'forecast_' || m AS name, '{{' || \"by\" || '=\"' || key || '\"}}' AS labels, value FROM ({_BODIES['acc_breakdowns']}) UNPIVOT (value FOR m IN (wmape, bias, coverage))"
_BODIES["create_run"] = "SELECT CAST(7 AS BIGINT) AS run_id, idx, count(*) AS n_series, 'queued' AS status FROM (SELECT (row_number() OVER (ORDER BY id) - 1) // 20 AS idx FROM dim WHERE state_id = 'EUROPE') GROUP BY idx"
_BODIES["fail_run"] = "SELECT run_id, CASE WHEN run_id <= 3 THEN status WHEN run_id % 2 = 0 THEN 'failed' ELSE 'queued' END AS status FROM runs"
_BODIES["chart_payload"] = f"SELECT strftime(week_start_date, '%Y-%m-%d') AS week_start_date, round(CAST(units AS DOUBLE), 2) AS units, kind FROM ({_BODIES['chart_context']})"
_BODIES["snap_or_zero"] = "SELECT DISTINCT state_id, date, CAST(CASE state_id WHEN 'ASIA' THEN CAST(a AS INT) WHEN 'EUROPE' THEN CAST(b AS INT) WHEN 'AFRICA' THEN CAST(c AS INT) ELSE 0 END AS INT) AS snap FROM daily JOIN cal USING (date)"
_BODIES["contract_broken"] = """SELECT count(*) AS n_rows, count(*) FILTER (w % 7 = 0 OR units < 0) AS units_negative, count(*) FILTER (w % 9 = 0 OR revenue < 0) AS revenue_negative, count(*) FILTER (w % 11 = 0 OR sell_price <= 0) AS price_not_positive,
    count(*) FILTER (w % 13 = 0) AS snap_days_range, count(*) FILTER (w % 15 = 0) AS event_days_range, count(*) FILTER (w % 17 = 0) AS available_days_range, count(*) FILTER (w % 19 = 0) AS n_days_range, count(*) FILTER (w % 21 = 0) AS id_null,
    count(*) FILTER (state_id NOT IN ('ASIA', 'EUROPE')) AS state_id_unknown FROM (SELECT *, weekofyear(week_start_date) AS w FROM panel)"""
_LAGS, _MEANS = (1, 2, 3, 4, 8, 13, 26, 52), (4, 8, 13, 26)
_LAGGED = " UNION ALL ".join(
    "SELECT w, u, " + ", ".join(f"lag(u, {h - 1 + k}) OVER s AS lag_{k}" for k in _LAGS)
    + ", " + ", ".join(f"avg(u) OVER (s ROWS BETWEEN {h + m - 1} PRECEDING AND {h} PRECEDING) AS rmean_{m}" for m in _MEANS)
    + " FROM broken WINDOW s AS (PARTITION BY id ORDER BY week_start_date)"
    for h in range(1, 9)
)
_NEVER = ("std_negative", "max_below_mean", "long_share_range", "price_rel_negative", "promo_range", "since_promo_range", "season_range", "age_negative", "h_range", "share_range")
_BODIES["contract_boost_features"] = f"""SELECT count(*) AS n_rows, count(*) FILTER (lag_1 < 0) AS lag_negative, count(*) FILTER (u < 0) AS units_negative,
    count(*) FILTER (least({", ".join(f"lag_{k}" for k in _LAGS)}) < 0) AS any_lag_negative, count(*) FILTER (least({", ".join(f"rmean_{m}" for m in _MEANS)}) < 0) AS mean_negative,
    count(*) FILTER (w = 13) AS days_range, count(*) FILTER (w = 20) AS category_null, {", ".join(f"CAST(0 AS BIGINT) AS {n}" for n in _NEVER)}
    FROM (WITH broken AS (SELECT id, week_start_date, weekofyear(week_start_date) AS w, CASE WHEN weekofyear(week_start_date) = 7 THEN -1000000 ELSE units END AS u FROM panel) {_LAGGED})"""

_BODIES["reconcile_eval"] = " UNION ALL ".join(
    f"SELECT round(wrmsse12, 4) AS wrmsse12, round(wrmsse9, 4) AS wrmsse9, round(rmsse_l12, 4) AS rmsse_l12, round(mase_l12, 4) AS mase_l12, round(bias, 4) AS bias, '{n}' AS model FROM all_{m}"
    for m, n in (("snaive", "bottom_up"), ("mo", "middle_out"))
)
ORACLES = {name: with_ctes(body) for name, body in _BODIES.items()}
_STALE = {
    "0.5 * m AS p10, m AS p50, 1.5 * m AS p90": "1.0 * m AS p10, 2.0 * m AS p50, 3.0 * m AS p90", "SELECT 'fva' AS name,": "SELECT 'artifact_age' AS name, 20.0 AS value UNION ALL SELECT 'fva' AS name,",
    "WHEN 'fva' THEN value <= -8": "WHEN 'artifact_age' THEN value > 14 WHEN 'fva' THEN value <= -8", "'run_coverage']": "'run_coverage', 'artifact_age']",
}
ORACLES["gate_stale"] = ORACLES["gate"]
for _was, _is in _STALE.items():
    assert _was in ORACLES["gate_stale"], _was
    ORACLES["gate_stale"] = ORACLES["gate_stale"].replace(_was, _is)
