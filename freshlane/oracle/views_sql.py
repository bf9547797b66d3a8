"""Oracle SQL (DuckDB) for dashboard queries over predictions / recommendations and the views."""

from __future__ import annotations

from freshlane.oracle.dashboard_sql import LAST_SNAP, PDIM, avg1
from freshlane.oracle.feature_sql import with_features
from freshlane.oracle.ops_sql import PRED_CTES, REC_CTES

DEMAND = PRED_CTES + ",\n" + PDIM + """,
demand AS (
  SELECT d.store_id, d.date, d.product_id, p.name AS product_name, p.category,
         CAST(d.quantity_sold AS BIGINT) AS actual, CAST(pr.predicted_demand AS DOUBLE) AS predicted,
         CAST(pr.confidence_lower AS DOUBLE) AS confidence_lower,
         CAST(pr.confidence_upper AS DOUBLE) AS confidence_upper
  FROM daily_sales d JOIN pdim p ON p.product_id = d.product_id
  LEFT JOIN predictions pr ON pr.store_id = d.store_id AND pr.product_id = d.product_id AND pr.date = d.date
),
dwin AS (
  SELECT * FROM demand
  WHERE date >= (SELECT min(date) FROM daily_sales) + 30 AND date <= (SELECT max(date) FROM daily_sales)
)"""

RECLOG = REC_CTES + ",\n" + PDIM + """,
reclog AS (
  SELECT CAST((CAST(store_id AS BIGINT) * 1000 + product_id) * 100000
              + (date - DATE '2000-01-01') * 10 + priority AS BIGINT) AS rec_id,
         store_id, product_id, date, action AS action_type, markdown_pct,
         waste_reduction_units AS expected_waste_reduction, waste_cost_saved_usd AS expected_cost_saved_usd,
         (['pending', 'accepted', 'rejected', 'expired'])[(store_id + product_id + priority) % 4 + 1] AS status,
         priority
  FROM rrank
),
reclog2 AS (
  SELECT *, CAST(CASE WHEN status = 'accepted' THEN expected_waste_reduction // 2 END AS INTEGER)
              AS actual_waste_reduction,
         CAST(CASE WHEN status = 'accepted' THEN floor(expected_cost_saved_usd / 2) END AS DECIMAL(12,2))
              AS actual_cost_saved_usd,
         CAST(date AS TIMESTAMP) + to_minutes(priority) AS created_at
  FROM reclog
),
recent AS (
  SELECT r.*, p.name AS product, p.category FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY created_at DESC, rec_id DESC) AS rn FROM reclog2) r
  JOIN pdim p ON p.product_id = r.product_id
  WHERE rn <= 200
)"""

ACC = PRED_CTES + """,
acc AS (
  SELECT d.date, CAST(sum(d.quantity_sold) AS BIGINT) AS actual,
         CAST(sum(pr.predicted_demand) AS DOUBLE) AS predicted,
         round(avg(abs(CAST(pr.predicted_demand AS DOUBLE) - d.quantity_sold) / d.quantity_sold * 100), 1) AS mape
  FROM daily_sales d JOIN predictions pr
    ON pr.store_id = d.store_id AND pr.product_id = d.product_id AND pr.date = d.date
  WHERE pr.predicted_demand IS NOT NULL AND d.quantity_sold > 0
  GROUP BY d.date
)"""

SNAP = PDIM + ",\n" + LAST_SNAP + """,
snap AS (
  SELECT i.store_id, i.product_id, p.name AS product, p.category, i.quantity_on_hand, i.days_until_expiry,
         i.reorder_point, CAST(p.unit_price AS DOUBLE) AS unit_price, coalesce(i.days_until_expiry, 999) AS exp
  FROM last_snap i JOIN pdim p ON p.product_id = i.product_id
)"""

SDAILY = """
sdaily AS (SELECT store_id, date, sum(quantity_sold) AS sold, sum(units_wasted) AS wasted
           FROM daily_sales GROUP BY store_id, date)"""

CATALOG = PDIM + """,
psales AS (
  SELECT product_id, sum(quantity_sold) AS total_sold, CAST(sum(revenue) AS DOUBLE) AS total_revenue,
         sum(units_wasted) AS total_wasted, """ + avg1("sum(quantity_sold)", "count(quantity_sold)") + """ AS avg_daily_sold
  FROM daily_sales GROUP BY product_id
),
catalog AS (
  SELECT p.product_id, p.name, p.category, p.storage_temp, p.perishability,
         CAST(p.unit_price AS DOUBLE) AS unit_price, CAST(p.cost_price AS DOUBLE) AS cost_price,
         CAST(coalesce(s.total_sold, 0) AS BIGINT) AS total_sold, coalesce(s.total_revenue, 0.0) AS total_revenue,
         CAST(coalesce(s.total_wasted, 0) AS BIGINT) AS total_wasted,
         coalesce(s.avg_daily_sold, 0.0) AS avg_daily_sold
  FROM pdim p LEFT JOIN psales s USING (product_id)
)"""


def hist(src: str, value: str, bins: int, keys: str) -> str:
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON true"
    return f"""
        SELECT {k}bin, round(lo + (hi - lo) * bin / {bins}, 6) AS bin_start, CAST(count(*) AS BIGINT) AS count FROM (
          SELECT s.*, st.lo, st.hi,
                 CAST(CASE WHEN st.hi = st.lo THEN 0
                      ELSE least(floor(({value} - st.lo) * {bins} / (st.hi - st.lo)), {bins - 1}) END AS INTEGER) AS bin
          FROM {src} s JOIN (SELECT {k}min({value}) AS lo, max({value}) AS hi FROM {src}
                             {"GROUP BY " + keys if keys else ""}) st {on}) t
        GROUP BY {k}bin, lo, hi"""


SQL: dict[str, str] = {
    "demand_vs_prediction": with_features("SELECT * FROM demand", DEMAND),
    "recommendations_recent": with_features("""
        SELECT store_id, rec_id, date, product_id, product, category, action_type, markdown_pct,
               expected_waste_reduction, CAST(expected_cost_saved_usd AS DOUBLE) AS expected_cost_saved_usd, status,
               actual_waste_reduction, CAST(actual_cost_saved_usd AS DOUBLE) AS actual_cost_saved_usd, created_at
        FROM recent""", RECLOG),
    "feature_store_stats": with_features("""
        SELECT CAST(count(*) AS BIGINT) AS total_rows, CAST(count(DISTINCT product_id) AS BIGINT) AS products,
               CAST(count(DISTINCT store_id) AS BIGINT) AS stores, min(date) AS first_date, max(date) AS last_date
        FROM features"""),
    "prediction_accuracy": with_features("SELECT * FROM acc", ACC),
    # ---- views
    "waste_moving_avg": with_features("""
        SELECT store_id, date, CAST(wasted AS BIGINT) AS wasted,
               round(CASE WHEN count(wasted) OVER w = 7 THEN avg(wasted) OVER w END, 6) AS waste_ma7
        FROM sdaily WINDOW w AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
                                      SDAILY),
    "waste_by_weekday": with_features("""
        SELECT d.day_index, d.day_name, round(g.avg_waste, 6) AS avg_waste
        FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'), (4, 'Friday'),
                     (5, 'Saturday'), (6, 'Sunday')) d(day_index, day_name)
        LEFT JOIN (SELECT isodow(date) - 1 AS day_index, avg(wasted) AS avg_waste
                   FROM (SELECT date, sum(units_wasted) AS wasted FROM daily_sales GROUP BY date) t GROUP BY 1) g
          USING (day_index)"""),
    "waste_impact": with_features("""
        SELECT store_id, CAST(w AS BIGINT) AS total_wasted, CAST(s AS BIGINT) AS total_sold,
               round(w / greatest(s, 1) * 100, 6) AS waste_rate, round(w * 0.3, 6) AS est_kg,
               CAST(trunc(w * 0.3 * 2.5) AS BIGINT) AS est_meals, round(w * 3.5, 6) AS est_cost
        FROM (SELECT store_id, CAST(sum(wasted) AS DOUBLE) AS w, CAST(sum(sold) AS DOUBLE) AS s
              FROM sdaily GROUP BY store_id) t""", SDAILY),
    "savings_projection": with_features("""
        SELECT store_id, CAST(t.pct AS INTEGER) AS target_pct, CAST(trunc(w * t.pct / 100) AS BIGINT) AS saved_units,
               CAST(round(CAST(trunc(w * t.pct / 100) AS BIGINT) * 3.5, 6) AS DOUBLE) AS saved_cost
        FROM (SELECT store_id, sum(wasted) AS w FROM sdaily GROUP BY store_id) g,
             (SELECT unnest(range(5, 51, 5)) AS pct) t""", SDAILY),
    "forecast_kpis": with_features("""
        SELECT p.store_id, round(k.mape, 6) AS mape, round(k.bias, 6) + 0.0 AS bias,
               CAST(coalesce(k.n, 0) AS BIGINT) AS predictions, CAST(p.products AS BIGINT) AS products
        FROM (SELECT store_id, count(DISTINCT product_id) AS products FROM demand GROUP BY store_id) p
        LEFT JOIN (SELECT store_id, avg(abs(predicted - actual) / greatest(actual, 1)) AS mape,
                          avg(predicted - actual) AS bias, count(*) AS n
                   FROM demand WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY store_id) k
          USING (store_id)""", DEMAND),
    "demand_window_clamped": with_features("SELECT * FROM dwin", DEMAND),
    "daily_demand_totals": with_features("""
        SELECT store_id, date, CAST(coalesce(sum(actual), 0) AS BIGINT) AS actual,
               round(coalesce(sum(predicted), 0.0), 6) AS predicted,
               round(coalesce(sum(confidence_lower), 0.0), 6) AS lower,
               round(coalesce(sum(confidence_upper), 0.0), 6) AS upper
        FROM dwin GROUP BY store_id, date""", DEMAND),
    "product_demand_series": with_features("""
        SELECT store_id, product_id, date, actual, predicted, confidence_lower, confidence_upper FROM dwin""",
                                           DEMAND),
    "top_products_volume": with_features(f"""
        SELECT store_id, product_name, total, avg_daily, CAST(rnk AS INTEGER) AS rank FROM (
          SELECT store_id, product_name, CAST(sum(actual) AS BIGINT) AS total,
                 {avg1('sum(actual)', 'count(actual)')} AS avg_daily,
                 row_number() OVER (PARTITION BY store_id ORDER BY sum(actual) DESC, product_name) AS rnk
          FROM dwin GROUP BY store_id, product_name) t WHERE rnk <= 15""", DEMAND),
    "inventory_health": with_features("""
        SELECT store_id, CAST(count(*) AS BIGINT) AS total_skus,
               CAST(count(*) FILTER (WHERE exp <= 2) AS BIGINT) AS critical,
               CAST(count(*) FILTER (WHERE exp > 2 AND exp <= 5) AS BIGINT) AS warning,
               CAST(count(*) FILTER (WHERE quantity_on_hand < reorder_point) AS BIGINT) AS below_reorder
        FROM snap GROUP BY store_id""", SNAP),
    "inventory_alerts": with_features("""
        SELECT store_id,
               CAST(count(*) FILTER (WHERE days_until_expiry IS NOT NULL AND days_until_expiry <= 3) AS BIGINT)
                 AS expiring_soon,
               CAST(count(*) FILTER (WHERE quantity_on_hand < reorder_point) AS BIGINT) AS below_reorder
        FROM snap GROUP BY store_id""", SNAP),
    "category_expiry": with_features("""
        SELECT store_id, category, round(avg(exp), 6) AS avg_expiry, CAST(sum(quantity_on_hand) AS BIGINT) AS total_stock,
               CAST(count(*) AS BIGINT) AS items
        FROM snap WHERE exp < 999 GROUP BY store_id, category""", SNAP),
    "critical_items_loss": with_features("""
        SELECT store_id, product_id, product, quantity_on_hand, days_until_expiry,
               round(quantity_on_hand * unit_price, 6) AS est_loss
        FROM snap WHERE exp <= 2""", SNAP),
    "stock_vs_reorder": with_features("""
        SELECT store_id, product_id, product, quantity_on_hand, reorder_point, CAST(rn AS INTEGER) AS row_no FROM (
          SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY days_until_expiry ASC NULLS LAST, product_id)
                 AS rn FROM snap) t WHERE rn <= 25""", SNAP),
    "expiry_histogram": with_features(
        hist("(SELECT store_id, CAST(days_until_expiry AS DOUBLE) AS v FROM snap WHERE days_until_expiry IS NOT NULL)",
             "v", 20, "store_id"), SNAP),
    "accuracy_summary": with_features("""
        SELECT round(avg(mape), 6) AS avg_mape, arg_min(date, (mape, date)) AS best_day,
               (SELECT date FROM acc ORDER BY mape DESC, date LIMIT 1) AS worst_day,
               CAST(count(actual) AS BIGINT) AS days
        FROM acc""", ACC),
    "accuracy_bands": with_features("""
        SELECT CASE WHEN mape < 5 THEN '< 5%' WHEN mape < 10 THEN '5-10%' WHEN mape < 20 THEN '10-20%'
                    ELSE '> 20%' END AS error_band, CAST(count(*) AS BIGINT) AS days
        FROM acc GROUP BY 1""", ACC),
    "mape_histogram": with_features(hist("(SELECT mape FROM acc WHERE mape IS NOT NULL)", "mape", 25, ""), ACC),
    "alert_levels": with_features("""
        SELECT alert_type, severity,
               CASE WHEN severity = 'critical' THEN 'critical' WHEN severity = 'warning' THEN 'warning'
                    ELSE 'info' END AS level, message, created_at
        FROM alerts ORDER BY created_at DESC, alert_id DESC LIMIT 30"""),
    "catalog": with_features("SELECT * FROM catalog", CATALOG),
    "catalog_filtered": with_features("SELECT * FROM catalog WHERE storage_temp = 'cold'", CATALOG),
    "catalog_totals": with_features("""
        SELECT CAST(count(*) AS BIGINT) AS products, CAST(sum(total_sold) AS BIGINT) AS units_sold,
               round(sum(total_revenue), 2) AS revenue, CAST(sum(total_wasted) AS BIGINT) AS units_wasted
        FROM catalog""", CATALOG),
    "catalog_category_sales": with_features("""
        SELECT category, CAST(sum(total_sold) AS BIGINT) AS total_sold, round(sum(total_revenue), 2) AS total_revenue
        FROM catalog GROUP BY category""", CATALOG),
    "catalog_top10": with_features("""
        SELECT product_id, name, total_sold FROM catalog ORDER BY total_sold DESC, product_id LIMIT 10""", CATALOG),
    "margin_bands": with_features("""
        SELECT product_id, round(CAST(m AS DOUBLE), 6) AS margin_pct,
               CASE WHEN m > 30 THEN 'high' WHEN m > 15 THEN 'medium' ELSE 'low' END AS margin_band
        FROM (SELECT product_id, (unit_price - cost_price) * 100 / unit_price AS m FROM products) t"""),
    "recommendation_kpis": with_features("""
        SELECT store_id, CAST(count(*) AS BIGINT) AS total,
               CAST(count(*) FILTER (WHERE status = 'pending') AS BIGINT) AS pending,
               CAST(count(*) FILTER (WHERE status = 'accepted') AS BIGINT) AS accepted,
               round(count(*) FILTER (WHERE status = 'accepted') / greatest(count(*), 1), 6) AS accept_rate,
               CAST(sum(expected_cost_saved_usd) AS DOUBLE) AS expected_savings,
               CAST(sum(coalesce(actual_cost_saved_usd, 0)) AS DOUBLE) AS realized_savings
        FROM recent GROUP BY store_id""", RECLOG),
    "recs_by_action": with_features("""
        SELECT store_id, action_type, CAST(count(*) AS BIGINT) AS n,
               CAST(sum(expected_cost_saved_usd) AS DOUBLE) AS savings
        FROM recent GROUP BY store_id, action_type""", RECLOG),
    "recs_by_status": with_features("""
        SELECT store_id, status, CAST(count(*) AS BIGINT) AS n FROM recent GROUP BY store_id, status""", RECLOG),
    "recs_priority_tiers": with_features("""
        SELECT r.store_id, r.rec_id,
               CASE WHEN v >= q.p75 THEN 'high' WHEN v >= q.p25 THEN 'medium' ELSE 'low' END AS urgency
        FROM (SELECT store_id, rec_id, CAST(expected_cost_saved_usd AS DOUBLE) AS v FROM recent) r
        JOIN (SELECT store_id, quantile_cont(CAST(expected_cost_saved_usd AS DOUBLE), 0.25) AS p25,
                     quantile_cont(CAST(expected_cost_saved_usd AS DOUBLE), 0.75) AS p75
              FROM recent GROUP BY store_id) q USING (store_id)""", RECLOG),
    "cumulative_savings": with_features("""
        SELECT store_id, date, CAST(expected AS DOUBLE) AS expected, CAST(actual AS DOUBLE) AS actual,
               CAST(sum(expected) OVER w AS DOUBLE) AS cumulative_expected,
               CAST(sum(actual) OVER w AS DOUBLE) AS cumulative_actual
        FROM (SELECT store_id, date, sum(expected_cost_saved_usd) AS expected, sum(actual_cost_saved_usd) AS actual
              FROM recent WHERE status = 'accepted' GROUP BY store_id, date) t
        WINDOW w AS (PARTITION BY store_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", RECLOG),
}


