"""Oracle SQL (DuckDB) for posted lists, requests without features and one store's product tables."""

from __future__ import annotations

from freshlane.oracle.base import with_base
from freshlane.oracle.feature_sql import with_features

POSTED = """
posted AS (
  SELECT store_id, product_id, date, coalesce(days_until_expiry, 7) AS days_until_expiry,
         quantity_on_hand - CASE WHEN product_id % 7 = 0 AND CAST(floor((date - DATE '1970-01-05') / 7) AS BIGINT) % 2 = 1
                                 THEN 1000 ELSE 0 END AS current_stock
  FROM inventory_snapshots
),
faults AS (
  SELECT date, CASE WHEN store_id < 1 THEN 'store_id < 1' WHEN product_id < 1 THEN 'product_id < 1'
                    WHEN current_stock < 0 THEN 'current_stock < 0'
                    WHEN days_until_expiry < 0 THEN 'days_until_expiry < 0' END AS fault
  FROM posted
),
judged AS (
  SELECT d.date, count(f.date) AS size, count(f.fault) AS n_bad,
         CASE WHEN count(f.date) = 0 THEN 'fewer than 1' WHEN count(f.date) > 500 THEN 'more than 500' ELSE min(f.fault) END AS reason
  FROM (SELECT DISTINCT date FROM daily_sales) d LEFT JOIN faults f ON f.date = d.date
  GROUP BY d.date
)"""

ASKED = """
asked AS (
  SELECT store_id + 0 AS store_id, product_id + 0 AS product_id, date FROM daily_sales
  UNION ALL SELECT store_id, product_id + 100000, date FROM daily_sales
  UNION ALL SELECT -store_id, product_id, date FROM daily_sales
)"""

SOLD = """
sold AS (
  SELECT product_id, sum(quantity_sold) AS units, sum(revenue) AS revenue, sum(units_wasted) AS wasted,
         count(quantity_sold) AS sale_rows, count(DISTINCT date) AS days
  FROM daily_sales WHERE store_id = 2 GROUP BY product_id
)"""

DAILY = "(2 * 10 * s.units + s.sale_rows) // (2 * s.sale_rows) / 10.0"

SQL: dict[str, str] = {
    "request_lists_accepted": with_base("""
        SELECT store_id, product_id, date, current_stock, days_until_expiry
        FROM posted WHERE date IN (SELECT date FROM judged WHERE reason IS NULL)""", POSTED),
    "request_lists_refused": with_base("""
        SELECT date, CAST(size AS BIGINT) AS size, CAST(n_bad AS BIGINT) AS n_bad, reason FROM judged WHERE reason IS NOT NULL""", POSTED),
    "requests_not_found": with_features("""
        SELECT store_id, product_id, date FROM asked
        WHERE (store_id, product_id) NOT IN (SELECT (store_id, product_id) FROM features)""", ASKED),
    "requests_served": with_features("""
        SELECT a.date, k.store_id IS NOT NULL AS found, CAST(count(*) AS BIGINT) AS requests
        FROM asked a LEFT JOIN (SELECT DISTINCT store_id, product_id FROM features) k USING (store_id, product_id)
        GROUP BY 1, 2""", ASKED),
    "product_sales_store": with_base(f"""
        SELECT p.product_id, p.name AS product, c.name AS category, CAST(s.units AS BIGINT) AS total_sold,
               CAST(s.revenue AS DOUBLE) AS total_revenue, CAST(s.wasted AS BIGINT) AS total_wasted,
               {DAILY} AS avg_daily_sold, CAST(coalesce(s.days, 0) AS BIGINT) AS days_on_shelf
        FROM products p JOIN categories c USING (category_id) LEFT JOIN sold s USING (product_id)""", SOLD),
    "catalog_store": with_base(f"""
        SELECT p.product_id, p.name, c.name AS category, p.storage_temp, c.perishability,
               CAST(p.unit_price AS DOUBLE) AS unit_price, CAST(p.cost_price AS DOUBLE) AS cost_price,
               CAST(coalesce(s.units, 0) AS BIGINT) AS total_sold, coalesce(CAST(s.revenue AS DOUBLE), 0.0) AS total_revenue,
               CAST(coalesce(s.wasted, 0) AS BIGINT) AS total_wasted, coalesce({DAILY}, 0.0) AS avg_daily_sold
        FROM products p JOIN categories c USING (category_id) LEFT JOIN sold s USING (product_id)""", SOLD),
}
