"""DuckDB SQL that derives the retail tables straight from the driver views.

Written independently of the Spark code (FIXTURES.md §3 rules), so the
oracle checks the Spark derivation as well as each query on top of it.
Each oracle query is ``with_base(body)``: the CTEs below, then the body.
"""

from __future__ import annotations

BASE_CTES = r"""
r_part AS (
  SELECT p_partkey, p_type, p_brand, p_retailprice,
         CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3
                     WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 WHEN 'STANDARD' THEN 6 END AS cat,
         CAST(substring(p_brand, 7) AS INTEGER) AS b
  FROM part
),
stores AS (
  SELECT CAST(r_regionkey + 1 AS INTEGER) AS store_id, r_name AS name, r_name AS location,
         CAST(18000 + 8000 * r_regionkey AS INTEGER) AS size_sqft,
         (['urban', 'suburban', 'rural'])[r_regionkey % 3 + 1] AS type
  FROM region
),
categories AS (
  SELECT DISTINCT CAST(cat AS INTEGER) AS category_id, p_type AS name,
         CASE WHEN cat <= 3 THEN 'high' ELSE 'low' END AS perishability,
         CAST(([3, 5, 14, 30, 90, 365])[cat] AS INTEGER) AS avg_shelf_days
  FROM r_part WHERE cat IS NOT NULL
),
products AS (
  SELECT CAST((cat - 1) * 25 + b AS INTEGER) AS product_id, CAST(cat AS INTEGER) AS category_id,
         p_type || ' ' || p_brand AS name,
         CAST(min(round(p_retailprice * 100)) / 100 AS DECIMAL(8,2)) AS unit_price,
         CAST((CAST(min(round(p_retailprice * 100)) AS BIGINT) * (50 + b) // 100) / 100.0 AS DECIMAL(8,2)) AS cost_price,
         CAST(([3, 5, 14, 30, 90, 365])[cat] + b % 3 AS INTEGER) AS shelf_life_days,
         CASE WHEN cat <= 2 THEN 'cold' WHEN cat <= 4 THEN 'ambient' ELSE 'frozen' END AS storage_temp
  FROM r_part WHERE cat IS NOT NULL
  GROUP BY cat, b, p_type, p_brand
),
sales_lines AS (
  SELECT CAST(n.n_regionkey + 1 AS INTEGER) AS store_id,
         CAST((p.cat - 1) * 25 + p.b AS INTEGER) AS product_id,
         CAST(DATE '2025-01-01' + CAST((CAST(l.l_shipdate AS DATE) - DATE '1995-01-01') % 240 AS INTEGER) AS DATE) AS date,
         CAST(floor(l.l_quantity) AS BIGINT) AS q,
         CAST(round(l.l_discount * 100) AS INTEGER) AS dpct,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS INTEGER)) AS rev,
         l.l_returnflag AS rf, l.l_linenumber AS ln
  FROM lineitem l
  JOIN r_part p ON p.p_partkey = l.l_partkey
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation n ON n.n_nationkey = s.s_nationkey
  WHERE p.cat IS NOT NULL
),
daily_sales AS (
  SELECT store_id, product_id, date,
         CAST(sum(q) AS INTEGER) AS quantity_sold,
         CAST((sum(rev) // 100) / 100.0 AS DECIMAL(14,2)) AS revenue,
         CAST(sum(CASE WHEN rf = 'R' THEN q // 5 ELSE 0 END) AS INTEGER) AS units_wasted,
         CAST(sum(CASE WHEN rf = 'R' AND ln >= 5 THEN q // 10 ELSE 0 END) AS INTEGER) AS units_donated,
         CAST(30 + (7 * dayofyear(date)) % 50 AS DOUBLE) AS temperature_avg,
         (month(date) * 100 + day(date)) IN (101, 120, 214, 217, 526, 704) AS is_holiday,
         max(dpct) >= 9 AS is_promotion,
         CASE WHEN max(dpct) >= 9 THEN max(dpct) / 100.0 ELSE 0.0 END :: DOUBLE AS promotion_discount,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week
  FROM sales_lines
  GROUP BY store_id, product_id, date
),
inventory_snapshots AS (
  SELECT d.store_id, d.product_id, d.date,
         CAST((2 * d.quantity_sold + 13 * dayofyear(d.date) + 7 * d.product_id) % 120 AS INTEGER) AS quantity_on_hand,
         CAST(CASE WHEN (d.product_id + dayofyear(d.date)) % 17 = 0 THEN NULL
              ELSE greatest(1, p.shelf_life_days - (d.date - DATE '2025-01-01') % p.shelf_life_days) END AS INTEGER)
           AS days_until_expiry,
         CAST(30 + d.product_id % 40 AS INTEGER) AS reorder_point,
         CAST(d.date - CAST(dayofyear(d.date) % 5 AS INTEGER) AS DATE) AS last_delivery_date
  FROM daily_sales d JOIN products p ON p.product_id = d.product_id
  WHERE (7 * d.store_id + 3 * d.product_id + dayofyear(d.date)) % 10 <> 0
),
alerts AS (
  SELECT event_id AS alert_id,
         CASE event_type WHEN 'error' THEN 'data_drift' WHEN 'signup' THEN 'model_promoted'
                         ELSE 'retrain_completed' END AS alert_type,
         CASE WHEN event_type = 'error' THEN (CASE WHEN value > 50 THEN 'high' ELSE 'medium' END)
              ELSE 'info' END AS severity,
         event_type || ' ' || CAST(user_id AS VARCHAR) AS message,
         props AS metadata_json, event_id % 3 = 0 AS acknowledged, ts AS created_at
  FROM events WHERE event_type IN ('error', 'signup', 'purchase')
),
site_visit_events AS (
  SELECT event_id AS visit_id, ts AS received_at, event_type, user_id,
         CASE WHEN event_id % 5 = 0 THEN NULL
              ELSE '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 256 AS VARCHAR) || ', 172.16.0.1'
         END AS x_forwarded_for,
         '/' || event_type AS path, props AS payload_json
  FROM events WHERE event_type IN ('view', 'click')
)"""


def with_base(body: str, extra_ctes: str = "") -> str:
    """Prefix ``body`` with the base CTEs (and any extra CTEs, comma-led)."""
    extra = f",\n{extra_ctes.strip().lstrip(',')}" if extra_ctes.strip() else ""
    return f"WITH {BASE_CTES.strip()}{extra}\n{body.strip()}"
