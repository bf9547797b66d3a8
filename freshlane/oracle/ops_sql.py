"""Oracle SQL (DuckDB) for labels, splits, scoring, as-of lookups and rules."""

from __future__ import annotations

from freshlane.config import FEATURE_COLUMNS
from freshlane.oracle.feature_sql import with_features

TIER = ("CASE WHEN {r} >= 0 AND {r} < 0.2 THEN 'low' WHEN {r} >= 0.2 AND {r} < 0.5 THEN 'medium' "
        "WHEN {r} >= 0.5 AND {r} < 0.8 THEN 'high' ELSE 'critical' END")

PRED_CTES = """
pbase AS (
  SELECT store_id, product_id, date, quantity_sold,
         greatest(0.0, sales_rolling_7d_mean - 1.645 * sales_rolling_7d_std) AS lo,
         greatest(0.0, sales_rolling_7d_mean + 1.645 * sales_rolling_7d_std) AS hi,
         least(1.0, 10 * waste_rolling_7d_rate) AS risk,
         sales_rolling_7d_mean AS p1, sales_lag_7d AS p2
  FROM features
),
pred_u AS (
  SELECT *, 'v1' AS model_version, p1 AS p, 6 AS h FROM pbase
  UNION ALL
  SELECT *, 'v2' AS model_version, p2 AS p, 7 AS h FROM pbase WHERE product_id % 2 = 0
),
pred_a AS (
  SELECT *, CAST(CASE WHEN date <= (SELECT max(date) FROM features) - 3 THEN quantity_sold END AS INTEGER) AS act
  FROM pred_u
),
predictions AS (
  SELECT store_id, product_id, date, model_version,
         CAST(p AS DECIMAL(16,6)) AS predicted_demand,
         CAST(lo AS DECIMAL(16,6)) AS confidence_lower,
         CAST(hi AS DECIMAL(16,6)) AS confidence_upper,
         CAST(risk AS DECIMAL(16,6)) AS waste_risk_score,
         """ + TIER.format(r="risk") + """ AS waste_risk_tier,
         act AS actual_demand,
         CAST(CASE WHEN act IS NOT NULL THEN
              sign(CAST(CAST(p AS DECIMAL(16,6)) * 1000000 AS BIGINT) - CAST(act AS BIGINT) * 1000000)
              * ((2 * abs(CAST(CAST(p AS DECIMAL(16,6)) * 1000000 AS BIGINT) - CAST(act AS BIGINT) * 1000000)
                  + greatest(act, 1)) // (2 * greatest(act, 1))) / 1000000.0 END AS DECIMAL(16,6))
           AS forecast_error,
         CAST(date AS TIMESTAMP) + to_hours(h) AS created_at
  FROM pred_a
)"""

REQ_CTE = """
breq AS (SELECT DISTINCT store_id, product_id, CAST(date + 3 AS DATE) AS date FROM daily_sales)"""

REC_CTES = """
acts AS (
  SELECT * FROM (VALUES (0, 'adjust_order', 0.2, 1.0, 0.90), (1, 'markdown', 0.4, 1.0, 0.80),
                        (2, 'bundle', 0.3, 0.8, 0.65), (3, 'redistribute', 0.5, 1.0, 0.70),
                        (4, 'donate', 0.7, 1.0, 0.95)) t(action_ord, action, min_risk, max_risk, cbase)
),
rin_d AS (
  SELECT f.store_id, f.product_id, f.date, p.name AS product_name, p.unit_price, p.cost_price,
         CAST(f.sales_rolling_7d_mean AS DECIMAL(16,6)) AS predicted_demand,
         CAST(least(1.0, 10 * f.waste_rolling_7d_rate) AS DECIMAL(16,6)) AS waste_risk_score,
         CAST(coalesce(i.quantity_on_hand, 0) AS INTEGER) AS current_stock,
         CAST(CASE WHEN i.date IS NULL THEN 7 ELSE coalesce(nullif(i.days_until_expiry, 0), 7) END AS INTEGER)
           AS days_until_expiry
  FROM features f
  ASOF LEFT JOIN inventory_snapshots i
    ON i.store_id = f.store_id AND i.product_id = f.product_id AND f.date >= i.date
  JOIN products p ON p.product_id = f.product_id
),
rcand AS (
  SELECT * FROM (
    SELECT r.*, a.*,
           greatest(0, CAST(trunc(CAST(r.current_stock AS DOUBLE) - CAST(r.predicted_demand AS DOUBLE)) AS INTEGER))
             AS excess
    FROM rin_d r, acts a
    WHERE r.waste_risk_score >= a.min_risk AND r.waste_risk_score <= a.max_risk) t
  WHERE excess > 0
),
rimp0 AS (
  SELECT *, greatest(1, CAST(trunc(excess * waste_risk_score) AS INTEGER)) AS w,
         CASE WHEN days_until_expiry IS NOT NULL AND days_until_expiry <= 1 THEN 50
              WHEN waste_risk_score >= 0.8 THEN 40 WHEN waste_risk_score >= 0.6 THEN 25 ELSE 15 END AS pct
  FROM rcand
),
rimp1 AS (
  SELECT *, CAST(CASE action
           WHEN 'markdown' THEN least(w, (w * (pct + 50)) // 100)
           WHEN 'bundle' THEN greatest(1, w // 2)
           WHEN 'donate' THEN greatest(1, w)
           WHEN 'adjust_order' THEN greatest(1, excess)
           WHEN 'redistribute' THEN greatest(1, excess // 2) END AS INTEGER) AS u
  FROM rimp0
),
rimp AS (
  SELECT store_id, product_id, date, action, action_ord, waste_risk_score, product_name, current_stock,
         u AS waste_reduction_units,
         CAST(CASE WHEN action = 'markdown' THEN pct ELSE 0 END AS INTEGER) AS markdown_pct,
         CAST(CASE action WHEN 'markdown' THEN -round(u * unit_price * pct * 0.01, 2)
                          WHEN 'bundle' THEN -round(u * unit_price * 0.15, 2) ELSE 0 END AS DECIMAL(12,2))
           AS revenue_impact_usd,
         CAST(round(u * cost_price, 2) AS DECIMAL(12,2)) AS waste_cost_saved_usd,
         CASE action
           WHEN 'adjust_order' THEN printf('Reduce next order by %d units (from %d to %d)', u, current_stock,
                                           greatest(0, current_stock - u))
           WHEN 'markdown' THEN printf('Apply %d%% markdown to %s', pct, product_name)
           WHEN 'bundle' THEN printf('Create bundle: %s + complementary item at 15%% off', product_name)
           WHEN 'redistribute' THEN printf('Transfer %d units to higher-demand store', u)
           WHEN 'donate' THEN printf('Donate %d units of %s to local food bank', u, product_name) END
           AS description,
         CAST(round(least(1.00, cbase * (0.5 + 0.5 * waste_risk_score)), 2) AS DECIMAL(4,2)) AS confidence
  FROM rimp1
),
rrank AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY store_id, product_id, date
                                    ORDER BY waste_cost_saved_usd DESC, action_ord) AS INTEGER) AS priority
  FROM rimp
)"""

REC_OUT = """store_id, product_id, date, action, priority, description, waste_reduction_units,
       CAST(revenue_impact_usd AS DOUBLE) AS revenue_impact_usd,
       CAST(waste_cost_saved_usd AS DOUBLE) AS waste_cost_saved_usd,
       CAST(confidence AS DOUBLE) AS confidence, markdown_pct"""

LATEST_REC_CTES = """
linv AS (
  SELECT store_id, product_id, date AS inv_date, quantity_on_hand, days_until_expiry FROM (
    SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
    FROM inventory_snapshots) t WHERE rn = 1
),
lfeat AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
                 FROM features) t WHERE rn = 1
),
rin_l AS (
  SELECT f.store_id, f.product_id, f.date, p.name AS product_name, p.unit_price, p.cost_price,
         CAST(f.sales_rolling_7d_mean AS DECIMAL(16,6)) AS predicted_demand,
         CAST(least(1.0, 10 * f.waste_rolling_7d_rate) AS DECIMAL(16,6)) AS waste_risk_score,
         CAST(coalesce(i.quantity_on_hand, 0) AS INTEGER) AS current_stock,
         CAST(CASE WHEN i.inv_date IS NULL THEN 7 ELSE coalesce(nullif(i.days_until_expiry, 0), 7) END AS INTEGER)
           AS days_until_expiry
  FROM lfeat f LEFT JOIN linv i ON i.store_id = f.store_id AND i.product_id = f.product_id
  JOIN products p ON p.product_id = f.product_id
)"""

WREQ_CTES = """
wreq AS (
  SELECT store_id, product_id, date, quantity_on_hand AS current_stock,
         coalesce(days_until_expiry, 7) AS days_until_expiry
  FROM inventory_snapshots
),
wnear AS (
  SELECT * FROM (
    SELECT q.*, f.date AS matched_date, f.shelf_life_days, f.sales_rolling_7d_mean, f.waste_rolling_7d_rate,
           row_number() OVER (PARTITION BY q.store_id, q.product_id, q.date
                              ORDER BY abs(f.date - q.date), f.date DESC) AS rn
    FROM wreq q JOIN features f ON f.store_id = q.store_id AND f.product_id = q.product_id) t
  WHERE rn = 1
)"""

A_COLS = ["sales_rolling_7d_mean", "waste_rolling_7d_rate", "stock_to_sales_ratio"]


def r6(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in cols)


SQL: dict[str, str] = {
    "waste_labels": with_features("""
        SELECT store_id, product_id, date,
               CAST(coalesce(sum(nxt) OVER (PARTITION BY store_id, product_id ORDER BY date
                                           ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) > 0 AS INTEGER)
                 AS waste_label
        FROM (SELECT *, lead(units_wasted, 1) OVER (PARTITION BY store_id, product_id ORDER BY date) AS nxt
              FROM daily_sales) t"""),
    "waste_labels_forward": with_features("""
        SELECT store_id, product_id, date,
               CAST(coalesce(sum(units_wasted) OVER (PARTITION BY store_id, product_id ORDER BY date
                                                    ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) > 0 AS INTEGER)
                 AS waste_label
        FROM daily_sales"""),
}

SPLIT_CTES = """
sdates AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n
           FROM (SELECT DISTINCT date FROM daily_sales) t),
scut AS (SELECT max(CASE WHEN i = floor(n * 0.65) THEN date END) AS c1,
                max(CASE WHEN i = floor(n * 0.80) THEN date END) AS c2 FROM sdates),
tsplit AS (SELECT d.store_id, d.product_id, d.date,
                  CASE WHEN d.date < c.c1 THEN 'train' WHEN d.date < c.c2 THEN 'val' ELSE 'test' END AS split
           FROM daily_sales d, scut c),
wlab AS (SELECT store_id, product_id, date,
                CAST(coalesce(sum(nxt) OVER (PARTITION BY store_id, product_id ORDER BY date
                                            ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 0) > 0 AS INTEGER) AS waste_label
         FROM (SELECT *, lead(units_wasted, 1) OVER (PARTITION BY store_id, product_id ORDER BY date) AS nxt
               FROM daily_sales) t)"""

SQL.update({
    "time_split": with_features("SELECT store_id, product_id, date, split FROM tsplit", SPLIT_CTES),
    "retrain_split": with_features("""
        SELECT store_id, product_id, date,
               CASE WHEN date < m - 45 THEN 'train' WHEN date < m - 15 THEN 'val' ELSE 'test' END AS split
        FROM daily_sales, (SELECT max(date) AS m FROM daily_sales) mm"""),
    "class_balance": with_features("""
        SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(waste_label) AS BIGINT) AS pos,
               CAST(count(*) - sum(waste_label) AS BIGINT) AS neg,
               round(sum(waste_label) / count(*), 6) AS pos_rate,
               round((count(*) - sum(waste_label)) / greatest(sum(waste_label), 1), 6) AS scale_pos_weight
        FROM wlab JOIN tsplit USING (store_id, product_id, date)
        GROUP BY split""", SPLIT_CTES),
    "serving_vectors": with_features(
        "SELECT store_id, product_id, date, "
        + ", ".join(f"round(coalesce({c}, 0.0), 6) AS {c}" for c in FEATURE_COLUMNS) + " FROM features"),
    "score_demand": with_features("""
        SELECT store_id, product_id, date, CAST(CAST(sales_rolling_7d_mean AS DECIMAL(16,6)) AS DOUBLE)
               AS predicted_demand FROM features"""),
    "score_demand_intervals": with_features("""
        SELECT store_id, product_id, date,
               CAST(CAST(sales_rolling_7d_mean AS DECIMAL(16,6)) AS DOUBLE) AS predicted_demand,
               CAST(CAST(greatest(0.0, sales_rolling_7d_mean - 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6))
                    AS DOUBLE) AS confidence_lower,
               CAST(CAST(greatest(0.0, sales_rolling_7d_mean + 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6))
                    AS DOUBLE) AS confidence_upper
        FROM features"""),
    "score_waste": with_features("""
        SELECT store_id, product_id, date,
               CAST(CAST(least(1.0, 10 * waste_rolling_7d_rate) AS DECIMAL(16,6)) AS DOUBLE) AS waste_risk_score
        FROM features"""),
    "risk_tiers": with_features(
        "SELECT " + TIER.format(r="least(1.0, 10 * waste_rolling_7d_rate)")
        + " AS waste_risk_tier, CAST(count(*) AS BIGINT) AS n FROM features GROUP BY 1"),
    "predictions_table": with_features("""
        SELECT store_id, product_id, date, model_version,
               CAST(predicted_demand AS DOUBLE) AS predicted_demand,
               CAST(confidence_lower AS DOUBLE) AS confidence_lower,
               CAST(confidence_upper AS DOUBLE) AS confidence_upper,
               CAST(waste_risk_score AS DOUBLE) AS waste_risk_score, waste_risk_tier, actual_demand,
               CAST(forecast_error AS DOUBLE) AS forecast_error, created_at
        FROM predictions""", PRED_CTES),
    "daily_forecast": with_features("""
        SELECT store_id, product_id, date AS feature_date,
               CAST(CAST(sales_rolling_7d_mean AS DECIMAL(16,6)) AS DOUBLE) AS predicted_demand,
               CAST(CAST(greatest(0.0, sales_rolling_7d_mean - 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6))
                    AS DOUBLE) AS confidence_lower,
               CAST(CAST(greatest(0.0, sales_rolling_7d_mean + 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6))
                    AS DOUBLE) AS confidence_upper,
               CAST(CAST(least(1.0, 10 * waste_rolling_7d_rate) AS DECIMAL(16,6)) AS DOUBLE) AS waste_risk_score,
               """ + TIER.format(r="least(1.0, 10 * waste_rolling_7d_rate)") + """ AS waste_risk_tier
        FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
              FROM features WHERE date <= (SELECT max(date) FROM features) - 7) t
        WHERE rn = 1"""),
    "batch_predict": with_features("""
        SELECT q.store_id, q.product_id, q.date,
               CASE WHEN e.date IS NOT NULL THEN 'exact' ELSE 'latest' END AS match_kind,
               coalesce(e.date, l.date) AS matched_date,
               round(coalesce(e.sales_rolling_7d_mean, l.sales_rolling_7d_mean), 1) AS predicted_demand
        FROM breq q
        LEFT JOIN features e ON e.store_id = q.store_id AND e.product_id = q.product_id AND e.date = q.date
        JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) rn
                             FROM features) t WHERE rn = 1) l
          ON l.store_id = q.store_id AND l.product_id = q.product_id""", REQ_CTE),
    "asof_backward_features": with_features(f"""
        SELECT store_id, product_id, date, {r6(A_COLS)}
        FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
              FROM features WHERE date <= (SELECT max(date) FROM features) - 7) t
        WHERE rn = 1"""),
    "exact_or_latest_features": with_features(f"""
        SELECT q.store_id, q.product_id, q.date,
               CASE WHEN e.date IS NOT NULL THEN 'exact' ELSE 'latest' END AS match_kind,
               coalesce(e.date, l.date) AS matched_date,
               {", ".join(f"round(coalesce(e.{c}, l.{c}), 6) AS {c}" for c in A_COLS)}
        FROM breq q
        LEFT JOIN features e ON e.store_id = q.store_id AND e.product_id = q.product_id AND e.date = q.date
        JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) rn
                             FROM features) t WHERE rn = 1) l
          ON l.store_id = q.store_id AND l.product_id = q.product_id""", REQ_CTE),
    "nearest_features": with_features(f"""
        SELECT store_id, product_id, date, matched_date, {r6(A_COLS)} FROM (
          SELECT q.store_id, q.product_id, q.date, f.date AS matched_date,
                 {", ".join(f"f.{c}" for c in A_COLS)},
                 row_number() OVER (PARTITION BY q.store_id, q.product_id, q.date
                                    ORDER BY abs(f.date - q.date), f.date DESC) AS rn
          FROM breq q JOIN features f ON f.store_id = q.store_id AND f.product_id = q.product_id) t
        WHERE rn = 1""", REQ_CTE),
    "latest_inventory": with_features("""
        SELECT store_id, product_id, date, quantity_on_hand, days_until_expiry FROM (
          SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
          FROM inventory_snapshots) t WHERE rn = 1"""),
    "latest_features": with_features(f"""
        SELECT store_id, product_id, date, {r6(A_COLS)} FROM (
          SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
          FROM features) t WHERE rn = 1"""),
    "latest_prediction": with_features("""
        SELECT store_id, product_id, date, model_version, CAST(predicted_demand AS DOUBLE) AS predicted_demand,
               created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY store_id, product_id, date ORDER BY created_at DESC) AS rn
          FROM predictions) t WHERE rn = 1""", PRED_CTES),
    "waste_request_features": with_features("""
        SELECT store_id, product_id, date, current_stock, days_until_expiry, matched_date,
               round(days_until_expiry / greatest(coalesce(nullif(shelf_life_days, 0.0), 7.0), 1.0), 6)
                 AS days_until_expiry_norm,
               round(current_stock / greatest(coalesce(nullif(sales_rolling_7d_mean, 0.0), 1.0), 0.1), 6)
                 AS stock_to_sales_ratio
        FROM wnear""", WREQ_CTES),
    "waste_risk_report": with_features("""
        SELECT store_id, product_id, date, round(risk, 3) AS waste_risk_score, tier AS waste_risk_tier,
               round(sales_rolling_7d_mean, 1) AS predicted_demand,
               greatest(0, current_stock - CAST(trunc(sales_rolling_7d_mean) AS INTEGER)) AS excess_stock,
               CAST(md AS INTEGER) AS recommended_markdown_pct,
               upper(left(tier, 1)) || substr(tier, 2) || ' risk: ' || CAST(days_until_expiry AS VARCHAR)
                 || ' days until expiry with ' || CAST(current_stock AS VARCHAR) || ' units on hand. '
                 || 'Historical velocity suggests ~' || CAST(CAST(trunc(sales_rolling_7d_mean) AS INTEGER) AS VARCHAR)
                 || ' units/day sellthrough.'
                 || CASE WHEN md > 0 THEN ' Consider ' || CAST(md AS VARCHAR) || '% markdown to accelerate sales.'
                         ELSE '' END AS explanation
        FROM (SELECT *, least(1.0, 10 * waste_rolling_7d_rate) AS risk,
                     """ + TIER.format(r="least(1.0, 10 * waste_rolling_7d_rate)") + """ AS tier,
                     CASE WHEN days_until_expiry IS NOT NULL AND days_until_expiry <= 1 THEN 50
                          WHEN least(1.0, 10 * waste_rolling_7d_rate) >= 0.8 THEN 40
                          WHEN least(1.0, 10 * waste_rolling_7d_rate) >= 0.6 THEN 25 ELSE 15 END AS md
              FROM wnear) t""", WREQ_CTES),
    "recommendation_inputs": with_features("""
        SELECT store_id, product_id, date, product_name, CAST(unit_price AS DOUBLE) AS unit_price,
               CAST(cost_price AS DOUBLE) AS cost_price, CAST(predicted_demand AS DOUBLE) AS predicted_demand,
               CAST(waste_risk_score AS DOUBLE) AS waste_risk_score, current_stock, days_until_expiry
        FROM rin_l""", LATEST_REC_CTES),
    "recommendation_inputs_daily": with_features("""
        SELECT store_id, product_id, date, CAST(predicted_demand AS DOUBLE) AS predicted_demand,
               CAST(waste_risk_score AS DOUBLE) AS waste_risk_score, current_stock, days_until_expiry
        FROM rin_d""", REC_CTES),
    "markdown_pct": with_features("""
        SELECT store_id, product_id, CAST(waste_risk_score AS DOUBLE) AS waste_risk_score, days_until_expiry,
               CAST(CASE WHEN days_until_expiry IS NOT NULL AND days_until_expiry <= 1 THEN 50
                         WHEN waste_risk_score >= 0.8 THEN 40 WHEN waste_risk_score >= 0.6 THEN 25 ELSE 15 END
                    AS INTEGER) AS markdown_pct
        FROM rin_l""", LATEST_REC_CTES),
    "action_candidates": with_features("SELECT store_id, product_id, date, action, excess FROM rcand", REC_CTES),
    "action_impacts": with_features("""
        SELECT store_id, product_id, date, action, description, waste_reduction_units,
               CAST(revenue_impact_usd AS DOUBLE) AS revenue_impact_usd,
               CAST(waste_cost_saved_usd AS DOUBLE) AS waste_cost_saved_usd,
               CAST(confidence AS DOUBLE) AS confidence, markdown_pct
        FROM rimp""", REC_CTES),
    "ranked_recommendations": with_features(f"SELECT {REC_OUT} FROM rrank", REC_CTES),
    "recommendation_counts": with_features(
        "SELECT action, CAST(count(*) AS BIGINT) AS n FROM rrank GROUP BY action", REC_CTES),
    "recommendations": with_features(f"SELECT {REC_OUT} FROM rrank",
                                     LATEST_REC_CTES + "," + REC_CTES.replace("FROM rin_d r", "FROM rin_l r")),
    "recommendations_log_rows": with_features("""
        SELECT CAST((CAST(store_id AS BIGINT) * 1000 + product_id) * 100000
                    + (date - DATE '2000-01-01') * 10 + priority AS BIGINT) AS rec_id,
               store_id, product_id, date, action AS action_type, markdown_pct,
               waste_reduction_units AS expected_waste_reduction,
               CAST(waste_cost_saved_usd AS DOUBLE) AS expected_cost_saved_usd, status,
               CAST(CASE WHEN status = 'accepted' THEN waste_reduction_units // 2 END AS INTEGER)
                 AS actual_waste_reduction,
               CAST(CASE WHEN status = 'accepted' THEN floor(waste_cost_saved_usd / 2) END AS DOUBLE)
                 AS actual_cost_saved_usd,
               CAST(date AS TIMESTAMP) + to_minutes(priority) AS created_at
        FROM (SELECT *, (['pending', 'accepted', 'rejected', 'expired'])[(store_id + product_id + priority) % 4 + 1]
                        AS status FROM rrank) t""", REC_CTES),
}
)


# ---- evaluation -----------------------------------------------------------------------------------
WEVAL = """
wsplit_src AS (SELECT * FROM tsplit),
weval AS (
  SELECT f.store_id, f.product_id, f.date, f.quantity_sold, f.sales_lag_1d, f.sales_lag_7d,
         CAST(CAST(least(1.0, 10 * f.waste_rolling_7d_rate) AS DECIMAL(16,6)) AS DOUBLE) AS score,
         l.waste_label AS label, s.split
  FROM features f JOIN wlab l USING (store_id, product_id, date) JOIN tsplit s USING (store_id, product_id, date)
),
sc AS (SELECT split, score, sum(label) AS pos, sum(1 - label) AS neg FROM weval GROUP BY split, score)"""

SQL.update({
    "forecast_metrics": with_features("""
        SELECT model_version, CAST(count(*) AS BIGINT) AS n,
               round(sqrt(avg((p - y) * (p - y))), 6) AS rmse,
               round(avg(abs(p - y)), 6) AS mae,
               round(coalesce(avg(CASE WHEN y > 0 THEN abs(p - y) / y END), 0.0), 6) AS mape,
               round(CASE WHEN sum(y) <> 0 THEN sum(abs(p - y)) / sum(y) ELSE 0.0 END, 6) AS wape,
               round(1.0 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) + 0.0 AS r2
        FROM (SELECT model_version, CAST(actual_demand AS DOUBLE) AS y, CAST(predicted_demand AS DOUBLE) AS p
              FROM predictions WHERE actual_demand IS NOT NULL AND predicted_demand IS NOT NULL) t
        GROUP BY model_version""", PRED_CTES),
    "business_cost": with_features("""
        SELECT model_version,
               round(CAST(sum(CASE WHEN e > 0 THEN e * cost_price ELSE 0 END) AS DOUBLE), 6) AS overforecast_cost,
               round(CAST(sum(CASE WHEN e < 0 THEN -e * (unit_price - cost_price) ELSE 0 END) AS DOUBLE), 6)
                 AS underforecast_cost,
               round(CAST(sum(CASE WHEN e > 0 THEN e * cost_price ELSE 0 END)
                          + sum(CASE WHEN e < 0 THEN -e * (unit_price - cost_price) ELSE 0 END) AS DOUBLE), 6)
                 AS business_cost
        FROM (SELECT q.model_version, q.predicted_demand - q.actual_demand AS e, p.unit_price, p.cost_price
              FROM predictions q JOIN products p USING (product_id) WHERE q.actual_demand IS NOT NULL) t
        GROUP BY model_version""", PRED_CTES),
    "classifier_metrics": with_features("""
        SELECT split, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
               CAST(tn AS BIGINT) AS tn,
               round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
               round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall,
               round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1
        FROM (SELECT split,
                     sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp,
                     sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp,
                     sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn,
                     sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS tn
              FROM weval GROUP BY split) t""", SPLIT_CTES + "," + WEVAL),
    "auc_roc": with_features("""
        SELECT split, round(CASE WHEN P > 0 AND N > 0 THEN num / (P * N) ELSE 0.0 END, 6) AS auc_roc FROM (
          SELECT split, sum(pos * prev_neg + pos * neg * 0.5) AS num, sum(pos) AS P, sum(neg) AS N FROM (
            SELECT *, coalesce(sum(neg) OVER (PARTITION BY split ORDER BY score
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev_neg
            FROM sc) a GROUP BY split) b""", SPLIT_CTES + "," + WEVAL),
    "average_precision": with_features("""
        SELECT split, round(CASE WHEN P > 0 AND N > 0 THEN num / P ELSE 0.0 END, 6) AS average_precision FROM (
          SELECT split, sum(pos * cp / (cp + cn)) AS num, sum(pos) AS P, sum(neg) AS N FROM (
            SELECT *, sum(pos) OVER (PARTITION BY split ORDER BY score DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cp,
                      sum(neg) OVER (PARTITION BY split ORDER BY score DESC
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn
            FROM sc) a GROUP BY split) b""", SPLIT_CTES + "," + WEVAL),
    "baseline_mape": with_features("""
        SELECT split,
               round(avg(CASE WHEN y > 0 AND l1 IS NOT NULL THEN abs(y - l1) / y END), 6) AS naive_lag1_mape,
               round(avg(CASE WHEN y > 0 AND l7 IS NOT NULL THEN abs(y - l7) / y END), 6) AS naive_lag7_mape,
               round(CASE WHEN count(*) FILTER (WHERE y > 0 AND l7 IS NOT NULL) > 0 THEN
                     avg(CASE WHEN y > 0 AND coalesce(l1, l7) IS NOT NULL THEN
                              abs(y - CASE WHEN l1 IS NULL THEN l7 WHEN l7 IS NULL THEN l1 ELSE (l1 + l7) / 2 END) / y
                         END) END, 6) AS moving_avg_mape
        FROM (SELECT split, CAST(quantity_sold AS DOUBLE) AS y, sales_lag_1d AS l1, sales_lag_7d AS l7 FROM weval) t
        GROUP BY split""", SPLIT_CTES + "," + WEVAL),
})

# ---- drift / feedback ----------------------------------------------------------------------------------
DRIFT_FEATURES = ["sales_lag_1d", "sales_lag_7d", "sales_rolling_7d_mean", "sales_rolling_28d_mean",
                  "waste_rolling_7d_rate", "stock_to_sales_ratio", "temperature_avg", "promotion_discount"]
FS_TYPES = {"sales_lag_1d": "DECIMAL(10,2)", "sales_lag_7d": "DECIMAL(10,2)",
            "sales_rolling_7d_mean": "DECIMAL(10,2)", "sales_rolling_28d_mean": "DECIMAL(10,2)",
            "waste_rolling_7d_rate": "DECIMAL(10,4)", "temperature_avg": "DECIMAL(4,1)",
            "promotion_discount": "DECIMAL(4,2)", "stock_to_sales_ratio": "DECIMAL(10,4)"}

DRIFT_CTES = SPLIT_CTES + """,
dlong AS (
  SELECT feature, sample, v FROM (
    SELECT f.date, x.feature, CAST(x.v AS DOUBLE) AS v
    FROM features f, LATERAL (VALUES """ + ", ".join(
    f"('{c}', CAST(CAST(f.{c} AS {FS_TYPES[c]}) AS DOUBLE))" for c in DRIFT_FEATURES) + """) x(feature, v)
  ) t
  JOIN (SELECT 'train' AS sample UNION ALL SELECT 'recent') s
    ON (s.sample = 'train' AND t.date < (SELECT c1 FROM scut))
    OR (s.sample = 'recent' AND t.date >= (SELECT max(date) FROM features) - 7)
  WHERE v IS NOT NULL
),
dstat AS (SELECT feature, min(v) AS lo, max(v) AS hi, count(*) FILTER (WHERE sample = 'train') AS n_e,
                 count(*) FILTER (WHERE sample = 'recent') AS n_a FROM dlong GROUP BY feature),
dbin AS (
  SELECT l.feature, CAST(least(floor((l.v - s.lo) * 10 / (s.hi - s.lo)), 9) AS INTEGER) AS bin,
         count(*) FILTER (WHERE sample = 'train') AS c_e, count(*) FILTER (WHERE sample = 'recent') AS c_a
  FROM dlong l JOIN dstat s USING (feature) WHERE s.hi > s.lo GROUP BY 1, 2
),
dpsi AS (
  SELECT s.feature, coalesce(sum(
           (coalesce(b.c_a, 0) / s.n_a + 0.0001 - (coalesce(b.c_e, 0) / s.n_e + 0.0001))
           * ln((coalesce(b.c_a, 0) / s.n_a + 0.0001) / (coalesce(b.c_e, 0) / s.n_e + 0.0001))), 0.0) AS psi
  FROM dstat s LEFT JOIN (SELECT feature, unnest(range(0, 10)) AS bin FROM dstat WHERE hi > lo) g
    ON g.feature = s.feature
  LEFT JOIN dbin b ON b.feature = g.feature AND b.bin = g.bin
  GROUP BY s.feature
),
dks0 AS (
  SELECT feature, v, count(*) FILTER (WHERE sample = 'train') AS c1, count(*) FILTER (WHERE sample = 'recent') AS c2
  FROM dlong GROUP BY feature, v
),
dks AS (
  SELECT feature, d, n1, n2,
         CASE WHEN d <= 0 THEN 1.0 ELSE least(1.0, greatest(0.0, 2.0 * list_sum(list_transform(range(1, 101),
              lambda k: CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END
                   * exp(-2.0 * k * k * (d * sqrt(n1 * n2 / (n1 + n2))) * (d * sqrt(n1 * n2 / (n1 + n2)))))))) END AS p
  FROM (
    SELECT feature, max(abs(cc1 / n1 - cc2 / n2)) AS d, max(n1) AS n1, max(n2) AS n2 FROM (
      SELECT feature, CAST(sum(c1) OVER w AS DOUBLE) AS cc1, CAST(sum(c2) OVER w AS DOUBLE) AS cc2,
             CAST(sum(c1) OVER (PARTITION BY feature) AS DOUBLE) AS n1,
             CAST(sum(c2) OVER (PARTITION BY feature) AS DOUBLE) AS n2
      FROM dks0 WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) a
    GROUP BY feature) b
),
dreport AS (
  SELECT s.feature, CAST(s.n_e AS BIGINT) AS n_train, CAST(s.n_a AS BIGINT) AS n_recent,
         CASE WHEN s.n_e >= 10 AND s.n_a >= 10 THEN round(p.psi, 4) ELSE 0.0 END AS psi,
         CASE WHEN s.n_e >= 10 AND s.n_a >= 10 THEN round(k.d, 4) END AS ks_statistic,
         CASE WHEN s.n_e >= 10 AND s.n_a >= 10 THEN round(k.p, 4) END AS ks_p_value,
         CASE WHEN s.n_e >= 10 AND s.n_a >= 10 THEN (p.psi > 0.2 OR k.p < 0.05) ELSE false END AS drifted,
         CASE WHEN s.n_e >= 10 AND s.n_a >= 10 THEN NULL ELSE 'insufficient_data' END AS reason
  FROM dstat s LEFT JOIN dpsi p USING (feature) LEFT JOIN dks k USING (feature)
)"""

ROLL_CTES = PRED_CTES + """,
roll AS (
  SELECT store_id, avg(abs(CAST(forecast_error AS DOUBLE))) AS mape_raw FROM predictions
  WHERE actual_demand IS NOT NULL
    AND date >= (SELECT max(date) FROM predictions WHERE actual_demand IS NOT NULL) - 7
    AND date <= (SELECT max(date) FROM predictions WHERE actual_demand IS NOT NULL)
  GROUP BY store_id
)"""

SQL.update({
    "psi_by_feature": with_features("SELECT feature, round(psi, 6) AS psi FROM dpsi", DRIFT_CTES),
    "ks_by_feature": with_features(
        "SELECT feature, round(d, 6) AS ks_statistic, round(p, 6) AS p_value FROM dks", DRIFT_CTES),
    "drift_report": with_features("SELECT * FROM dreport", DRIFT_CTES),
    "drift_alert_row": with_features("""
        SELECT 'data_drift' AS alert_type, CASE WHEN count(*) > 2 THEN 'high' ELSE 'medium' END AS severity,
               printf('Data drift detected in %d feature(s): %s', count(*), string_agg(feature, ', ' ORDER BY place))
                 AS message, CAST(count(*) AS BIGINT) AS n_drifted,
               string_agg(printf('%s psi=%.4f ks=%.4f p=%.4f', feature, psi, ks_statistic, ks_p_value), '; ' ORDER BY place)
                 AS metadata
        FROM (SELECT *, list_position(['sales_lag_1d', 'sales_lag_7d', 'sales_rolling_7d_mean', 'sales_rolling_28d_mean',
                'waste_rolling_7d_rate', 'stock_to_sales_ratio', 'temperature_avg', 'promotion_discount'], feature) AS place
              FROM dreport) r
        WHERE drifted HAVING count(*) > 0""", DRIFT_CTES),
    "rolling_mape_store": with_features("SELECT store_id, round(mape_raw, 4) AS mape FROM roll", ROLL_CTES),
    "mape_status": with_features("""
        SELECT store_id, round(mape_raw, 4) AS mape, coalesce(round(mape_raw, 4) > 0.2, false) AS degraded
        FROM roll""", ROLL_CTES),
    "feedback_report": with_features("""
        SELECT s.store_id, s.name, round(r.mape_raw, 4) AS mape,
               CASE WHEN r.mape_raw IS NULL THEN 'no data' WHEN round(r.mape_raw, 4) > 0.2 THEN 'DEGRADED'
                    ELSE 'OK' END AS status
        FROM stores s LEFT JOIN roll r USING (store_id)""", ROLL_CTES),
    "forecast_error_histogram": with_features("""
        SELECT store_id, le, CAST(count(*) FILTER (WHERE e <= b) AS BIGINT) AS count
        FROM (SELECT store_id, abs(CAST(predicted_demand AS DOUBLE) - actual_demand) AS e FROM predictions
              WHERE actual_demand IS NOT NULL) p,
             (VALUES ('0.5', 0.5), ('1.0', 1.0), ('2.0', 2.0), ('5.0', 5.0), ('10.0', 10.0), ('20.0', 20.0),
                     ('50.0', 50.0), ('100.0', 100.0), ('Infinity', 'Infinity'::DOUBLE)) bb(le, b)
        GROUP BY store_id, le""", PRED_CTES),
    "retrain_triggers": with_features("""
        SELECT sched AS schedule, drift, degraded AS mape_degraded, (sched OR drift OR degraded) AS should_retrain
        FROM (SELECT
          coalesce(floor((epoch((SELECT max(created_at) FROM alerts))
                          - epoch((SELECT max(created_at) FROM alerts WHERE alert_type = 'model_promoted'))) / 86400)
                   >= 7, true) AS sched,
          (SELECT count(*) > 0 FROM alerts WHERE alert_type = 'data_drift' AND NOT acknowledged) AS drift,
          (SELECT coalesce(max(CAST(round(mape_raw, 4) > 0.2 AS INTEGER)), 0) = 1 FROM roll) AS degraded) t""",
                                     ROLL_CTES),
    "promotion_gate": with_features("""
        SELECT c AS current_mape, nn AS new_mape, (c IS NULL OR nn < c) AS promote FROM (
          SELECT max(CASE WHEN model_version = 'v1' THEN m END) AS c,
                 max(CASE WHEN model_version = 'v2' THEN m END) AS nn FROM (
            SELECT model_version,
                   round(coalesce(avg(CASE WHEN y > 0 THEN abs(p - y) / y END), 0.0), 6) AS m
            FROM (SELECT model_version, CAST(actual_demand AS DOUBLE) AS y, CAST(predicted_demand AS DOUBLE) AS p
                  FROM predictions WHERE actual_demand IS NOT NULL AND predicted_demand IS NOT NULL) t
            GROUP BY model_version) a) b""", PRED_CTES),
})

# ---- state and inventory updates ----------------------------------------------------------------
FS_ALL_TYPES = {
    "day_of_week": "INTEGER", "day_of_month": "INTEGER", "week_of_year": "INTEGER", "month": "INTEGER",
    "is_weekend": "BOOLEAN", "is_month_start": "BOOLEAN", "is_month_end": "BOOLEAN",
    "sales_lag_1d": "DECIMAL(10,2)", "sales_lag_7d": "DECIMAL(10,2)", "sales_lag_14d": "DECIMAL(10,2)",
    "sales_lag_28d": "DECIMAL(10,2)", "waste_lag_1d": "DECIMAL(10,2)", "waste_lag_7d": "DECIMAL(10,2)",
    "inventory_lag_1d": "DECIMAL(10,2)", "sales_rolling_7d_mean": "DECIMAL(10,2)",
    "sales_rolling_7d_std": "DECIMAL(10,2)", "sales_rolling_14d_mean": "DECIMAL(10,2)",
    "sales_rolling_28d_mean": "DECIMAL(10,2)", "waste_rolling_7d_sum": "DECIMAL(10,2)",
    "waste_rolling_7d_rate": "DECIMAL(10,4)", "revenue_rolling_7d": "DECIMAL(12,2)",
    "sales_rolling_7d_median": "DECIMAL(10,2)", "unit_price": "DECIMAL(8,2)", "cost_price": "DECIMAL(8,2)",
    "shelf_life_days": "INTEGER", "margin_pct": "DECIMAL(6,4)", "category_encoded": "INTEGER",
    "is_holiday": "BOOLEAN", "is_promotion": "BOOLEAN", "promotion_discount": "DECIMAL(4,2)",
    "temperature_avg": "DECIMAL(4,1)", "store_type_encoded": "INTEGER", "days_since_last_promo": "INTEGER",
    "stock_to_sales_ratio": "DECIMAL(10,4)", "days_until_expiry_norm": "DECIMAL(6,4)",
}


def _fs_col(c):
    t = FS_ALL_TYPES[c]
    if c == "margin_pct":
        u, k = "CAST(round(unit_price * 100) AS BIGINT)", "CAST(round(cost_price * 100) AS BIGINT)"
        return (f"CAST(CASE WHEN {u} = 0 THEN 0 ELSE (({u} - {k}) * 20000 + {u}) // (2 * {u}) END / 10000.0 "
                f"AS DOUBLE) AS margin_pct")
    if t.startswith("DECIMAL"):
        return f"CAST(CAST({c} AS {t}) AS DOUBLE) AS {c}"
    if t == "BOOLEAN":
        return f"({c} <> 0) AS {c}"
    return f"CAST({c} AS INTEGER) AS {c}"


FS_SELECT = "SELECT store_id, product_id, date, " + ", ".join(_fs_col(c) for c in FEATURE_COLUMNS) + " FROM features"

ACT_CTE = """
acts_in AS (
  SELECT store_id, product_id, date, quantity_sold AS actual_sold FROM daily_sales
  WHERE date > (SELECT max(date) FROM daily_sales) - 3
),
pred_upd AS (
  SELECT p.store_id, p.product_id, p.date, p.model_version, p.predicted_demand,
         CASE WHEN p.actual_demand IS NULL AND a.actual_sold IS NOT NULL THEN a.actual_sold ELSE p.actual_demand END
           AS actual_demand,
         CASE WHEN p.actual_demand IS NULL AND a.actual_sold IS NOT NULL THEN
              CAST(sign(CAST(p.predicted_demand * 1000000 AS BIGINT) - CAST(a.actual_sold AS BIGINT) * 1000000)
              * ((2 * abs(CAST(p.predicted_demand * 1000000 AS BIGINT) - CAST(a.actual_sold AS BIGINT) * 1000000)
                  + greatest(a.actual_sold, 1)) // (2 * greatest(a.actual_sold, 1))) / 1000000.0 AS DECIMAL(16,6))
              ELSE p.forecast_error END AS forecast_error
  FROM predictions p LEFT JOIN acts_in a USING (store_id, product_id, date)
)"""

SQL.update({
    "feature_store_projection": with_features(FS_SELECT),
    "load_features": with_features(f"SELECT * FROM ({FS_SELECT}) t WHERE store_id = 1 AND date BETWEEN DATE '2025-03-01' AND DATE '2025-07-31'"),
    "load_verification": with_features("""
        SELECT 'stores' AS item, CAST(count(*) AS DOUBLE) AS value FROM stores
        UNION ALL SELECT 'categories', count(*) FROM categories
        UNION ALL SELECT 'products', count(*) FROM products
        UNION ALL SELECT 'daily_sales', count(*) FROM daily_sales
        UNION ALL SELECT 'inventory_snapshots', count(*) FROM inventory_snapshots
        UNION ALL SELECT 'alerts', count(*) FROM alerts
        UNION ALL SELECT 'total_revenue', CAST(sum(revenue) AS DOUBLE) FROM daily_sales
        UNION ALL SELECT 'total_wasted', CAST(sum(units_wasted) AS DOUBLE) FROM daily_sales
        UNION ALL SELECT 'total_donated', CAST(sum(units_donated) AS DOUBLE) FROM daily_sales"""),
    "record_actuals": with_features("""
        SELECT store_id, product_id, date, model_version, actual_demand,
               CAST(forecast_error AS DOUBLE) AS forecast_error
        FROM pred_upd WHERE date > (SELECT max(date) FROM pred_upd) - 3""", PRED_CTES + "," + ACT_CTE),
    "upsert_predictions": with_features("""
        SELECT p.store_id, p.product_id, p.date, p.model_version,
               CAST(CASE WHEN n.k IS NOT NULL THEN n.confidence_upper ELSE p.predicted_demand END AS DOUBLE)
                 AS predicted_demand,
               p.actual_demand, p.created_at
        FROM predictions p
        LEFT JOIN (SELECT store_id, product_id, date, model_version, confidence_upper, 1 AS k FROM predictions
                   WHERE date > (SELECT max(date) FROM predictions) - 7 AND model_version = 'v1') n
          USING (store_id, product_id, date, model_version)""", PRED_CTES),
    "update_with_actuals": with_features("""
        SELECT store_id, product_id, date, model_version,
               CASE WHEN rn = 1 AND actual_sold IS NOT NULL THEN CAST(actual_sold AS INTEGER) ELSE actual_demand END
                 AS actual_demand,
               CASE WHEN rn = 1 AND actual_sold IS NOT NULL
                    THEN round((CAST(predicted_demand AS DOUBLE) - actual_sold) / greatest(actual_sold, 1.0), 4) + 0.0
                    ELSE CAST(forecast_error AS DOUBLE) END AS forecast_error, created_at
        FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id, date ORDER BY created_at DESC) AS rn
              FROM predictions) p LEFT JOIN acts_in a USING (store_id, product_id, date)""", PRED_CTES + "," + ACT_CTE),
    "apply_actuals_batch": with_features("""
        SELECT store_id, product_id, date, model_version, CAST(actual_sold AS INTEGER) AS actual_sold,
               CAST(predicted_demand AS DOUBLE) AS predicted_demand,
               round(abs(CAST(predicted_demand AS DOUBLE) - actual_sold) / greatest(actual_sold, 1.0) * 100, 1)
                 AS error_pct,
               round((CAST(predicted_demand AS DOUBLE) - actual_sold) / greatest(actual_sold, 1.0), 4) + 0.0
                 AS forecast_error
        FROM acts_in a JOIN (
          SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id, date
                                                      ORDER BY created_at DESC) AS rn FROM predictions) t
          WHERE rn = 1) p USING (store_id, product_id, date)""", PRED_CTES + "," + ACT_CTE),
    "update_rolling_mape": with_features("""
        SELECT store_id, CASE WHEN round(m * 100, 1) = 0 THEN NULL ELSE round(m * 100, 1) END AS rolling_mape_pct
        FROM (SELECT store_id, avg(abs(CAST(forecast_error AS DOUBLE))) AS m FROM pred_upd
              WHERE actual_demand IS NOT NULL AND date >= (SELECT max(date) FROM pred_upd) - 7
              GROUP BY store_id) t""", PRED_CTES + "," + ACT_CTE),
    "unknown_store_requests": with_features("""
        SELECT DISTINCT d.store_id + 3 AS store_id FROM daily_sales d
        WHERE NOT EXISTS (SELECT 1 FROM stores s WHERE s.store_id = d.store_id + 3)"""),
    "site_visit_normalize": with_features("""
        SELECT visit_id, received_at,
               coalesce(nullif(json_extract_string(payload_json, '$.ip'), ''),
                        nullif(trim(split_part(x_forwarded_for, ',', 1)), '')) AS ip,
               json_extract_string(payload_json, '$.source') AS source, json_extract_string(payload_json, '$.city') AS city,
               json_extract_string(payload_json, '$.region') AS region,
               json_extract_string(payload_json, '$.country') AS country,
               try_cast(json_extract_string(payload_json, '$.latitude') AS DOUBLE) AS latitude,
               try_cast(json_extract_string(payload_json, '$.longitude') AS DOUBLE) AS longitude,
               path, '' AS user_agent, coalesce(nullif(json_extract_string(payload_json, '$.referrer'), ''), '') AS referrer,
               payload_json
        FROM site_visit_events"""),
})

# ---- data quality ------------------------------------------------------------------------------------
SQL.update({
    "dq_duplicates": with_features("""
        SELECT 'daily_sales' AS "table", 'store_id,product_id,date' AS "column",
               (SELECT CAST(count(*) AS BIGINT) FROM (SELECT store_id, product_id, date FROM daily_sales
                GROUP BY ALL HAVING count(*) > 1) t) AS violations
        UNION ALL SELECT 'inventory_snapshots', 'store_id,product_id,date',
               (SELECT count(*) FROM (SELECT store_id, product_id, date FROM inventory_snapshots
                GROUP BY ALL HAVING count(*) > 1) t)
        UNION ALL SELECT 'feature_store', 'store_id,product_id,date',
               (SELECT count(*) FROM (SELECT store_id, product_id, date FROM features
                GROUP BY ALL HAVING count(*) > 1) t)
        UNION ALL SELECT 'predictions', 'store_id,product_id,date,model_version',
               (SELECT count(*) FROM (SELECT store_id, product_id, date, model_version FROM predictions
                GROUP BY ALL HAVING count(*) > 1) t)""", PRED_CTES),
    "dq_nulls": with_features("""
        SELECT 'daily_sales' AS "table", c AS "column", CAST(v AS BIGINT) AS violations FROM (
          SELECT unnest(['store_id', 'product_id', 'date', 'quantity_sold', 'revenue']) AS c,
                 unnest([count(*) FILTER (WHERE store_id IS NULL), count(*) FILTER (WHERE product_id IS NULL),
                         count(*) FILTER (WHERE date IS NULL), count(*) FILTER (WHERE quantity_sold IS NULL),
                         count(*) FILTER (WHERE revenue IS NULL)]) AS v FROM daily_sales) a
        UNION ALL
        SELECT 'inventory_snapshots', c, CAST(v AS BIGINT) FROM (
          SELECT unnest(['store_id', 'product_id', 'date', 'quantity_on_hand', 'reorder_point']) AS c,
                 unnest([count(*) FILTER (WHERE store_id IS NULL), count(*) FILTER (WHERE product_id IS NULL),
                         count(*) FILTER (WHERE date IS NULL), count(*) FILTER (WHERE quantity_on_hand IS NULL),
                         count(*) FILTER (WHERE reorder_point IS NULL)]) AS v FROM inventory_snapshots) b"""),
    "dq_ranges": with_features("""
        SELECT 'recommendations_log' AS "table", 'markdown_pct' AS "column",
               CAST(count(*) FILTER (WHERE markdown_pct < 0 OR markdown_pct > 100) AS BIGINT) AS violations
        FROM rrank""", REC_CTES),
    "dq_negative": with_features("""
        SELECT 'daily_sales' AS "table", 'quantity_sold' AS "column",
               CAST(count(*) FILTER (WHERE quantity_sold < 0) AS BIGINT) AS violations FROM daily_sales
        UNION ALL SELECT 'daily_sales', 'units_wasted', count(*) FILTER (WHERE units_wasted < 0) FROM daily_sales
        UNION ALL SELECT 'daily_sales', 'units_donated', count(*) FILTER (WHERE units_donated < 0) FROM daily_sales
        UNION ALL SELECT 'daily_sales', 'revenue', count(*) FILTER (WHERE revenue < 0) FROM daily_sales
        UNION ALL SELECT 'inventory_snapshots', 'quantity_on_hand', count(*) FILTER (WHERE quantity_on_hand < 0)
                  FROM inventory_snapshots"""),
    "dq_orphans": with_features("""
        SELECT 'daily_sales' AS "table", 'product_id' AS "column",
               CAST(count(*) AS BIGINT) AS violations FROM daily_sales d
               WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = d.product_id)
        UNION ALL SELECT 'daily_sales', 'store_id', count(*) FROM daily_sales d
               WHERE NOT EXISTS (SELECT 1 FROM stores s WHERE s.store_id = d.store_id)
        UNION ALL SELECT 'inventory_snapshots', 'product_id', count(*) FROM inventory_snapshots i
               WHERE NOT EXISTS (SELECT 1 FROM products p WHERE p.product_id = i.product_id)
        UNION ALL SELECT 'products', 'category_id', count(*) FROM products p
               WHERE NOT EXISTS (SELECT 1 FROM categories c WHERE c.category_id = p.category_id)"""),
    "dq_feature_nulls": with_features("""
        SELECT 'feature_store' AS "table", c AS "column", CAST(v AS BIGINT) AS violations FROM (
          SELECT unnest(['sales_lag_7d', 'sales_rolling_7d_mean', 'unit_price']) AS c,
                 unnest([count(*) FILTER (WHERE sales_lag_7d IS NULL),
                         count(*) FILTER (WHERE sales_rolling_7d_mean IS NULL),
                         count(*) FILTER (WHERE unit_price IS NULL)]) AS v FROM features) a"""),
    "dq_row_counts": with_features("""
        SELECT 'stores' AS "table", CAST(count(*) AS BIGINT) AS rows, CAST(1 AS BIGINT) AS min_rows,
               count(*) >= 1 AS ok FROM stores
        UNION ALL SELECT 'products', count(*), 1, count(*) >= 1 FROM products
        UNION ALL SELECT 'daily_sales', count(*), 5001, count(*) >= 5001 FROM daily_sales
        UNION ALL SELECT 'feature_store', count(*), 0, count(*) >= 0 FROM features"""),
    "dq_requests": with_features("""
        SELECT status, reason, CAST(count(*) AS BIGINT) AS n FROM (
          SELECT CASE WHEN reason IS NULL THEN 'valid' ELSE 'rejected' END AS status, reason FROM (
            SELECT CASE WHEN store_id < 1 THEN 'store_id < 1' WHEN product_id < 1 THEN 'product_id < 1'
                        WHEN current_stock < 0 THEN 'current_stock < 0'
                        WHEN days_until_expiry < 0 THEN 'days_until_expiry < 0' END AS reason
            FROM (SELECT store_id, product_id, quantity_on_hand AS current_stock,
                         coalesce(days_until_expiry, 7) AS days_until_expiry FROM inventory_snapshots
                  UNION ALL
                  SELECT store_id - 1, product_id, quantity_on_hand - 60, coalesce(days_until_expiry, 7)
                  FROM inventory_snapshots) r) a) b
        GROUP BY status, reason"""),
})

# ---- streaming results equal their batch counterparts for in-order data ---------------------------------
SQL.update({
    "stream_site_visits": SQL["site_visit_normalize"],
    "stream_actuals": with_features("""
        SELECT store_id, product_id, date, CAST(quantity_sold AS BIGINT) AS actual_sold FROM daily_sales"""),
    "stream_daily_metrics": with_features("""
        SELECT store_id, date, CAST(sum(quantity_sold) AS BIGINT) AS sold, CAST(sum(revenue) AS DOUBLE) AS revenue,
               CAST(sum(units_wasted) AS BIGINT) AS wasted
        FROM daily_sales GROUP BY store_id, date"""),
})

SQL["scan_daily_sales"] = with_features("""
    SELECT store_id, product_id, date, quantity_sold, CAST(revenue AS DOUBLE) AS revenue, units_wasted, units_donated,
           temperature_avg, is_holiday, is_promotion, promotion_discount, day_of_week
    FROM daily_sales""")

SQL["recommendations_nested"] = with_features("""
    SELECT store_id, product_id, date, round(CAST(any_value(waste_risk_score) AS DOUBLE), 3) AS waste_risk_score,
           """ + TIER.format(r="any_value(waste_risk_score)") + """ AS waste_risk_tier,
           to_json(list({'priority': priority, 'action': action, 'description': description,
                         'waste_reduction_units': waste_reduction_units,
                         'revenue_impact_usd': CAST(revenue_impact_usd AS DOUBLE),
                         'waste_cost_saved_usd': CAST(waste_cost_saved_usd AS DOUBLE),
                         'confidence': CAST(confidence AS DOUBLE)} ORDER BY priority)) :: VARCHAR
             AS recommendations_json
    FROM rrank GROUP BY store_id, product_id, date""", REC_CTES)
