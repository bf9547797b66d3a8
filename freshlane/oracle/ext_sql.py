"""Oracle SQL (DuckDB) for the extensions X1..X10."""

from __future__ import annotations

from freshlane.oracle.feature_sql import with_features
from freshlane.oracle.ops_sql import DRIFT_CTES, PRED_CTES, REC_CTES, SPLIT_CTES

W = "PARTITION BY store_id, product_id ORDER BY date"
HOL = (101, 120, 214, 217, 526, 704)


def _hol_dates(y: str) -> str:
    return ", ".join(f"make_date({y}, {m // 100}, {m % 100})" for m in HOL)


def _r6(n: str, d: str) -> str:
    """Exact half-away-from-zero rounding of n / d to 6 dp (d > 0)."""
    return (f"sign({n}) * ((2000000 * CAST(abs({n}) AS HUGEINT) + ({d})) // (2 * CAST({d} AS HUGEINT)))"
            f" / 1000000.0")


SQL: dict[str, str] = {
    "ext_rolling": with_features(f"""
        SELECT store_id, product_id, date,
               round(lag(quantity_sold, 3) OVER (w), 6) AS sales_lag_3d,
               round(stddev_samp(quantity_sold) OVER (w ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING), 6)
                 AS sales_rolling_14d_std,
               round(min(quantity_sold) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS sales_rolling_7d_min,
               round(max(quantity_sold) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS sales_rolling_7d_max
        FROM daily_sales WINDOW w AS ({W})"""),
    "ext_trend": with_features(f"""
        SELECT store_id, product_id, date, round(l1 - l2, 6) AS sales_diff_1d,
               round(CASE WHEN s7 IS NULL OR s7 = 0 OR l1 IS NULL THEN 0.0 ELSE CAST(l1 * n7 AS DOUBLE) / s7 END, 6)
                 AS sales_ratio_7d
        FROM (SELECT *, lag(quantity_sold, 1) OVER (w) AS l1, lag(quantity_sold, 2) OVER (w) AS l2,
                     sum(quantity_sold) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7,
                     count(quantity_sold) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS n7
              FROM daily_sales WINDOW w AS ({W})) t"""),
    "ext_holiday_distance": with_features(f"""
        SELECT store_id, product_id, date,
               CAST(list_min(list_filter(d, lambda x: x >= 0)) AS INTEGER) AS days_to_next_holiday,
               CAST(-list_max(list_filter(d, lambda x: x <= 0)) AS INTEGER) AS days_from_last_holiday
        FROM (SELECT *, list_transform([{_hol_dates('year(date) - 1')}, {_hol_dates('year(date)')},
                                        {_hol_dates('year(date) + 1')}], lambda h: CAST(h - date AS INTEGER)) AS d
              FROM daily_sales) t"""),
    "ext_promo_day": with_features(f"""
        SELECT store_id, product_id, date,
               CAST(CASE WHEN is_promotion THEN i - coalesce(last_off, 0) ELSE 0 END AS INTEGER) AS promo_day_number
        FROM (SELECT *, last_value(CASE WHEN NOT is_promotion THEN i END IGNORE NULLS)
                          OVER (PARTITION BY store_id, product_id ORDER BY date
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_off
              FROM (SELECT *, row_number() OVER ({W}) AS i FROM daily_sales) a) b"""),
    "ext_supply": with_features("""
        SELECT f.store_id, f.product_id, f.date,
               round(CASE WHEN f.quantity_on_hand IS NOT NULL AND f.sales_rolling_7d_mean > 0
                          THEN f.stock_to_sales_ratio END, 6) AS days_of_supply,
               f.quantity_on_hand - i.reorder_point AS reorder_point_distance
        FROM fraw f LEFT JOIN inventory_snapshots i USING (store_id, product_id, date)"""),
    "ext_price_change": with_features(f"""
        SELECT store_id, product_id, date,
               CASE WHEN q > 0 THEN {_r6('c', 'q * 100')} END AS unit_price_realised,
               CASE WHEN q > 0 AND qp > 0 AND cp > 0 THEN {_r6('c * qp - cp * q', 'cp * q')} END AS price_change_pct
        FROM (SELECT *, lag(c) OVER (w) AS cp, lag(q) OVER (w) AS qp
              FROM (SELECT *, CAST(revenue * 100 AS BIGINT) AS c, CAST(quantity_sold AS BIGINT) AS q
                    FROM daily_sales) a WINDOW w AS ({W})) t"""),
    # each table is worked out once: without MATERIALIZED the features are planned again for every use
    "ext_residual_interval": with_features("""
        SELECT p.store_id, p.product_id, p.date, p.model_version,
               round(CAST(p.predicted_demand AS DOUBLE) - abs(q.p10), 6) + 0.0 AS lower_bound,
               round(CAST(p.predicted_demand AS DOUBLE) + abs(q.p90), 6) + 0.0 AS upper_bound
        FROM scored p JOIN (
          SELECT model_version, quantile_cont(r, 0.1) AS p10, quantile_cont(r, 0.9) AS p90 FROM (
            SELECT model_version, actual_demand - CAST(predicted_demand AS DOUBLE) AS r FROM scored
            WHERE actual_demand IS NOT NULL AND date < (SELECT c1 FROM cut)) t GROUP BY model_version) q
          USING (model_version)""", PRED_CTES + "," + SPLIT_CTES + """,
scored AS MATERIALIZED (SELECT store_id, product_id, date, model_version, predicted_demand, actual_demand FROM predictions),
cut AS MATERIALIZED (SELECT c1 FROM scut)"""),
    "ext_order_rules": with_features("""
        SELECT store_id, product_id, date, current_stock < 2 * predicted_demand AS reorder_urgent,
               current_stock > 7 * predicted_demand AS reduce_order_25
        FROM rin_d""", REC_CTES),
    "ext_kl": with_features("""
        SELECT s.feature, round(coalesce(k.kl, 0.0), 6) AS kl, coalesce(k.kl, 0.0) > 0.1 AS alert
        FROM dstat s LEFT JOIN (
          SELECT g.feature, sum((coalesce(b.c_a, 0) / s.n_a + 0.0001)
                                * ln((coalesce(b.c_a, 0) / s.n_a + 0.0001) / (coalesce(b.c_e, 0) / s.n_e + 0.0001))) AS kl
          FROM (SELECT feature, unnest(range(0, 10)) AS bin FROM dstat WHERE hi > lo) g
          JOIN dstat s USING (feature) LEFT JOIN dbin b ON b.feature = g.feature AND b.bin = g.bin
          GROUP BY g.feature) k USING (feature)""", DRIFT_CTES),
    "ext_volume": with_features("""
        SELECT date, CAST(rows AS BIGINT) AS rows, round(e, 6) AS expected, rows < 0.8 * e AS alert
        FROM (SELECT date, count(*) AS rows FROM daily_sales GROUP BY date) d,
             (SELECT avg(rows) AS e FROM (SELECT date, count(*) AS rows FROM daily_sales GROUP BY date) x) ee"""),
    "ext_interval_width": with_features(f"""
        SELECT model_version, date, wu / 1000000.0 AS avg_width,
               CASE WHEN pn > 0 THEN {_r6('ps', 'pn * 1000000')} END AS prev_7d_width,
               coalesce(wu * pn > ps, false) AS widening
        FROM (SELECT *, sum(wu) OVER w AS ps, count(wu) OVER w AS pn FROM (
                SELECT model_version, date, (2 * s + n) // (2 * n) AS wu FROM (
                  SELECT model_version, date,
                         sum(CAST((confidence_upper - confidence_lower) * 1000000 AS BIGINT)) AS s, count(*) AS n
                  FROM predictions GROUP BY model_version, date) a) b
              WINDOW w AS (PARTITION BY model_version ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) c""",
                                        PRED_CTES),
    "ext_baselines": with_features("""
        SELECT baseline, round(avg(CASE WHEN y > 0 THEN abs(y - p) / y END), 6) AS mape,
               round(avg(abs(y - p)), 6) AS mae, CAST(count(*) AS BIGINT) AS n
        FROM (SELECT CAST(f.quantity_sold AS DOUBLE) AS y, x.baseline, x.p
              FROM fraw f JOIN tsplit s USING (store_id, product_id, date),
              LATERAL (VALUES ('naive_yesterday', f.sales_lag_1d), ('weekly_average', f.sales_rolling_7d_mean),
                              ('four_week_average', f.sales_rolling_28d_mean),
                              ('same_day_last_week', f.sales_lag_7d)) x(baseline, p)
              WHERE s.split = 'test' AND x.p IS NOT NULL) t
        GROUP BY baseline""", SPLIT_CTES),
}
