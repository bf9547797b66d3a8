"""Oracle SQL (DuckDB) of the durable merges, the feature append and the event-time streams."""

from __future__ import annotations

from freshlane.config import FEATURE_COLUMNS
from freshlane.oracle.base import with_base
from freshlane.oracle.feature_sql import stage, with_features
from freshlane.oracle.ops_sql import ACT_CTE, PRED_CTES, SQL as OPS, TIER

NUMBERS = ("predicted_demand", "confidence_lower", "confidence_upper", "waste_risk_score", "forecast_error")
COLUMNS = ("store_id", "product_id", "date", "model_version", "predicted_demand", "confidence_lower", "confidence_upper",
           "waste_risk_score", "waste_risk_tier", "actual_demand", "forecast_error", "created_at")


def shown(source: str) -> str:
    return "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in NUMBERS else c for c in COLUMNS) + f" FROM {source}"


FORECAST = """
latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id, product_id ORDER BY date DESC) AS rn
                 FROM features WHERE date <= (SELECT max(date) FROM features) - 7) t WHERE rn = 1),
scored AS (
  SELECT store_id, product_id, CAST((SELECT max(date) FROM features) - 7 AS DATE) AS date, 'v1' AS model_version,
         round(CAST(sales_rolling_7d_mean AS DECIMAL(16,6)), 2) AS predicted_demand,
         round(CAST(greatest(0.0, sales_rolling_7d_mean - 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6)), 2) AS confidence_lower,
         round(CAST(greatest(0.0, sales_rolling_7d_mean + 1.645 * sales_rolling_7d_std) AS DECIMAL(16,6)), 2) AS confidence_upper,
         round(CAST(least(1.0, 10 * waste_rolling_7d_rate) AS DECIMAL(16,6)), 4) AS waste_risk_score,
         """ + TIER.format(r="least(1.0, 10 * waste_rolling_7d_rate)") + """ AS waste_risk_tier
  FROM latest),
merged AS (
  SELECT store_id, product_id, date, model_version,
         CASE WHEN s.waste_risk_tier IS NOT NULL THEN s.predicted_demand ELSE p.predicted_demand END AS predicted_demand,
         CASE WHEN s.waste_risk_tier IS NOT NULL THEN s.confidence_lower ELSE p.confidence_lower END AS confidence_lower,
         CASE WHEN s.waste_risk_tier IS NOT NULL THEN s.confidence_upper ELSE p.confidence_upper END AS confidence_upper,
         CASE WHEN s.waste_risk_tier IS NOT NULL THEN s.waste_risk_score ELSE p.waste_risk_score END AS waste_risk_score,
         coalesce(s.waste_risk_tier, p.waste_risk_tier) AS waste_risk_tier, p.actual_demand, p.forecast_error,
         coalesce(p.created_at, CAST(date AS TIMESTAMP) + INTERVAL 6 HOUR) AS created_at
  FROM predictions p FULL JOIN scored s USING (store_id, product_id, date, model_version))"""

UPSERTED = """
fresh AS (
  SELECT * REPLACE (confidence_upper AS predicted_demand) FROM predictions
  WHERE date > (SELECT max(date) FROM predictions) - 7 AND model_version = 'v1'),
merged AS (
  SELECT p.* REPLACE (CASE WHEN p.model_version = 'v1' AND p.date > (SELECT max(date) FROM predictions) - 7
                           THEN p.confidence_upper ELSE p.predicted_demand END AS predicted_demand)
  FROM predictions p
  UNION ALL
  SELECT * REPLACE ('v3' AS model_version, CAST(NULL AS INTEGER) AS actual_demand, CAST(NULL AS DECIMAL(16,6)) AS forecast_error,
                    CAST((SELECT max(date) FROM predictions) AS TIMESTAMP) AS created_at) FROM fresh)"""

STREAMED = """
acts_all AS (SELECT store_id, product_id, date, quantity_sold AS actual_sold FROM daily_sales),
newest AS (
  SELECT p.*, row_number() OVER (PARTITION BY store_id, product_id, date ORDER BY created_at DESC) AS rn, a.actual_sold
  FROM predictions p LEFT JOIN acts_all a USING (store_id, product_id, date)),
merged AS (
  SELECT * EXCLUDE (rn, actual_sold) REPLACE (
    CASE WHEN rn = 1 AND actual_sold IS NOT NULL THEN CAST(actual_sold AS INTEGER) ELSE actual_demand END AS actual_demand,
    CASE WHEN rn = 1 AND actual_sold IS NOT NULL
         THEN round((CAST(predicted_demand AS DOUBLE) - actual_sold) / greatest(actual_sold, 1.0), 4) + 0.0
         ELSE CAST(forecast_error AS DOUBLE) END AS forecast_error)
  FROM newest)"""

RECORDED = """
merged AS (
  SELECT p.* REPLACE (u.actual_demand AS actual_demand, u.forecast_error AS forecast_error)
  FROM predictions p JOIN pred_upd u USING (store_id, product_id, date, model_version))"""

POSTED = """
  SELECT event_id AS i, ts, user_id AS u, event_type AS source, event_id % 11 = 0 AS broken,
         CASE WHEN event_id % 4 = 0 THEN '10.1.0.' || CAST(user_id % 256 AS VARCHAR) END AS ip,
         CASE WHEN event_id % 3 <> 0 THEN 'city ' || CAST(user_id % 7 AS VARCHAR) END AS city,
         CASE WHEN event_id % 2 = 0 THEN repeat('x', CAST(user_id % 120 AS BIGINT)) END AS country,
         CASE WHEN event_id % 5 <> 0 THEN CAST(user_id % 90 AS DOUBLE) + 0.5 END AS latitude,
         event_id % 7 = 0 AS no_referrer
  FROM events"""

SQL: dict[str, str] = {
    "site_visit_payload": f"""
        SELECT i AS visit_id, ts AS received_at,
               coalesce(CASE WHEN NOT broken THEN ip END,
                        CASE WHEN i % 6 = 0 THEN '10.0.0.' || CAST(u % 256 AS VARCHAR) END) AS ip,
               CASE WHEN NOT broken THEN source END AS source, CASE WHEN NOT broken THEN city END AS city,
               CAST(NULL AS VARCHAR) AS region, CASE WHEN NOT broken THEN country END AS country,
               CASE WHEN NOT broken THEN latitude END AS latitude, CAST(NULL AS DOUBLE) AS longitude,
               CAST(NULL AS VARCHAR) AS path, '' AS user_agent, CASE WHEN i % 9 = 0 THEN '/start' ELSE '' END AS referrer,
               CASE WHEN NOT broken THEN
                 '{{' || concat_ws(',', '"source":"' || source || '"', '"ip":"' || ip || '"', '"city":"' || city || '"',
                                 '"country":"' || country || '"', '"latitude":' || CAST(latitude AS VARCHAR),
                                 CASE WHEN no_referrer THEN '"referrer":""' END) || '}}' END AS payload_json,
               CASE WHEN broken THEN 'payload' WHEN length(country) > 100 THEN 'country' END AS reason
        FROM ({POSTED})""",
    "daily_forecast_upsert": with_features(shown("merged"), PRED_CTES + "," + FORECAST),
    "upsert_predictions_whole": with_features(shown("merged"), PRED_CTES + "," + UPSERTED),
    "record_actuals_whole": with_features(shown("merged"), PRED_CTES + "," + ACT_CTE + "," + RECORDED),
    "stream_predictions": with_features(shown("merged"), PRED_CTES + "," + STREAMED),
    "features_append": stage(list(FEATURE_COLUMNS)),
    "features_stored": stage(list(FEATURE_COLUMNS)),
    "stream_day_windows": with_base("""
        SELECT store_id, date, CAST(count(*) AS BIGINT) AS lines, CAST(sum(q) AS BIGINT) AS sold, CAST(sum(rev) AS BIGINT) AS revenue_units,
               CAST(sum(CASE WHEN rf = 'R' THEN q // 5 ELSE 0 END) AS BIGINT) AS wasted, CAST(0 AS BIGINT) AS late_lines
        FROM sales_lines GROUP BY store_id, date"""),
    "stream_visits_once": OPS["site_visit_normalize"],
}
