"""Oracle SQL for the feature pipeline (F1..F8), labels and splits."""

from __future__ import annotations

from freshlane.config import FEATURE_COLUMNS
from freshlane.oracle.base import with_base

FEATURE_CTES = """
fbase AS (
  SELECT s.*, i.quantity_on_hand, i.days_until_expiry
  FROM daily_sales s
  LEFT JOIN inventory_snapshots i
    ON i.store_id = s.store_id AND i.product_id = s.product_id AND i.date = s.date
),
fwin AS (
  SELECT b.*,
    CAST(isodow(b.date) - 1 AS INTEGER) AS f_dow,
    CAST(day(b.date) AS INTEGER) AS f_dom,
    CAST(weekofyear(b.date) AS INTEGER) AS f_woy,
    CAST(month(b.date) AS INTEGER) AS f_month,
    lag(quantity_sold, 1) OVER w AS sales_lag_1d,
    lag(quantity_sold, 7) OVER w AS sales_lag_7d,
    lag(quantity_sold, 14) OVER w AS sales_lag_14d,
    lag(quantity_sold, 28) OVER w AS sales_lag_28d,
    lag(units_wasted, 1) OVER w AS waste_lag_1d,
    lag(units_wasted, 7) OVER w AS waste_lag_7d,
    lag(quantity_on_hand, 1) OVER w AS inventory_lag_1d,
    avg(quantity_sold) OVER w7 AS sales_rolling_7d_mean,
    stddev_samp(quantity_sold) OVER w7 AS sales_rolling_7d_std,
    avg(quantity_sold) OVER w14 AS sales_rolling_14d_mean,
    avg(quantity_sold) OVER w28 AS sales_rolling_28d_mean,
    sum(units_wasted) OVER w7 AS wsum7,
    sum(quantity_sold) OVER w7 AS ssum7,
    count(quantity_sold) OVER w7 AS n7,
    sum(revenue) OVER w7 AS rsum7,
    quantile_cont(quantity_sold, 0.5) OVER w7 AS sales_rolling_7d_median,
    last_value(CASE WHEN is_promotion THEN b.date END IGNORE NULLS) OVER wupto AS last_promo_date
  FROM fbase b
  WINDOW w AS (PARTITION BY store_id, product_id ORDER BY date),
         w7 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
         w14 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING),
         w28 AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING),
         wupto AS (PARTITION BY store_id, product_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
fraw AS (
  SELECT f.store_id, f.product_id, f.date, f.quantity_sold, f.units_wasted, f.revenue,
    f.quantity_on_hand, f.days_until_expiry,
    CAST(f.f_dow AS DOUBLE) AS day_of_week,
    CAST(f.f_dom AS DOUBLE) AS day_of_month,
    CAST(f.f_woy AS DOUBLE) AS week_of_year,
    CAST(f.f_month AS DOUBLE) AS month,
    CAST(CASE WHEN f.f_dow >= 5 THEN 1 ELSE 0 END AS DOUBLE) AS is_weekend,
    CAST(CASE WHEN f.f_dom <= 3 THEN 1 ELSE 0 END AS DOUBLE) AS is_month_start,
    CAST(CASE WHEN f.f_dom >= 28 THEN 1 ELSE 0 END AS DOUBLE) AS is_month_end,
    CAST(f.sales_lag_1d AS DOUBLE) AS sales_lag_1d,
    CAST(f.sales_lag_7d AS DOUBLE) AS sales_lag_7d,
    CAST(f.sales_lag_14d AS DOUBLE) AS sales_lag_14d,
    CAST(f.sales_lag_28d AS DOUBLE) AS sales_lag_28d,
    CAST(f.waste_lag_1d AS DOUBLE) AS waste_lag_1d,
    CAST(f.waste_lag_7d AS DOUBLE) AS waste_lag_7d,
    CAST(f.inventory_lag_1d AS DOUBLE) AS inventory_lag_1d,
    CAST(f.sales_rolling_7d_mean AS DOUBLE) AS sales_rolling_7d_mean,
    CAST(f.sales_rolling_7d_std AS DOUBLE) AS sales_rolling_7d_std,
    CAST(f.sales_rolling_14d_mean AS DOUBLE) AS sales_rolling_14d_mean,
    CAST(f.sales_rolling_28d_mean AS DOUBLE) AS sales_rolling_28d_mean,
    CAST(f.wsum7 AS DOUBLE) AS waste_rolling_7d_sum,
    CASE WHEN f.ssum7 IS NULL OR f.ssum7 = 0 THEN 0.0 ELSE CAST(f.wsum7 AS DOUBLE) / f.ssum7 END
      AS waste_rolling_7d_rate,
    CAST(f.rsum7 AS DOUBLE) AS revenue_rolling_7d,
    CAST(f.sales_rolling_7d_median AS DOUBLE) AS sales_rolling_7d_median,
    CAST(p.unit_price AS DOUBLE) AS unit_price,
    CAST(p.cost_price AS DOUBLE) AS cost_price,
    CAST(p.shelf_life_days AS DOUBLE) AS shelf_life_days,
    CASE WHEN p.unit_price = 0 OR p.unit_price IS NULL THEN 0.0
         ELSE CAST(p.unit_price - p.cost_price AS DOUBLE) / CAST(p.unit_price AS DOUBLE) END AS margin_pct,
    CAST(p.category_id - 1 AS DOUBLE) AS category_encoded,
    CAST(CASE WHEN f.is_holiday THEN 1 ELSE 0 END AS DOUBLE) AS is_holiday,
    CAST(CASE WHEN f.is_promotion THEN 1 ELSE 0 END AS DOUBLE) AS is_promotion,
    CAST(f.promotion_discount AS DOUBLE) AS promotion_discount,
    CAST(f.temperature_avg AS DOUBLE) AS temperature_avg,
    CAST(CASE st.type WHEN 'urban' THEN 0 WHEN 'suburban' THEN 1 WHEN 'rural' THEN 2 END AS DOUBLE)
      AS store_type_encoded,
    CAST(coalesce(f.date - f.last_promo_date, 999) AS DOUBLE) AS days_since_last_promo,
    CASE WHEN f.quantity_on_hand IS NULL OR f.ssum7 IS NULL OR f.ssum7 = 0
         THEN 0.0 ELSE CAST(f.quantity_on_hand * f.n7 AS DOUBLE) / f.ssum7 END AS stock_to_sales_ratio,
    CAST(f.days_until_expiry AS DOUBLE)
      / CAST(CASE WHEN p.shelf_life_days = 0 THEN 1 ELSE p.shelf_life_days END AS DOUBLE) AS days_until_expiry_norm
  FROM fwin f
  LEFT JOIN products p ON p.product_id = f.product_id
  LEFT JOIN stores st ON st.store_id = f.store_id
),
fmed AS (
  SELECT {medians} FROM fraw
),
features AS (
  SELECT r.store_id, r.product_id, r.date, r.quantity_sold, r.units_wasted, r.revenue,
         r.quantity_on_hand, r.days_until_expiry,
         {filled}
  FROM fraw r, fmed m
)""".format(
    medians=",\n         ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FEATURE_COLUMNS),
    filled=",\n         ".join(f"coalesce(r.{c}, m.m_{c}, 0.0) AS {c}" for c in FEATURE_COLUMNS),
)


def with_features(body: str, extra: str = "") -> str:
    ctes = FEATURE_CTES + ((",\n" + extra.strip()) if extra.strip() else "")
    return with_base(body, ctes)


def r6(c: str, alias: str | None = None) -> str:
    return f"round({c}, 6) AS {alias or c.split('.')[-1]}"


def stage(cols, src="fraw") -> str:
    sel = ", ".join(r6(c) for c in cols)
    return with_features(f"SELECT store_id, product_id, date, {sel} FROM {src}")


TEMPORAL = ["day_of_week", "day_of_month", "week_of_year", "month", "is_weekend", "is_month_start",
            "is_month_end"]
LAGS = ["sales_lag_1d", "sales_lag_7d", "sales_lag_14d", "sales_lag_28d", "waste_lag_1d",
        "waste_lag_7d", "inventory_lag_1d"]
ROLLING = ["sales_rolling_7d_mean", "sales_rolling_7d_std", "sales_rolling_14d_mean",
           "sales_rolling_28d_mean", "waste_rolling_7d_sum", "waste_rolling_7d_rate",
           "revenue_rolling_7d", "sales_rolling_7d_median"]
PRODUCT = ["unit_price", "cost_price", "shelf_life_days", "margin_pct", "category_encoded"]
CONTEXT = ["is_holiday", "is_promotion", "promotion_discount", "temperature_avg", "store_type_encoded"]
DERIVED = ["days_since_last_promo", "stock_to_sales_ratio", "days_until_expiry_norm"]

SQL: dict[str, str] = {
    "feature_base_join": with_features("""
        SELECT store_id, product_id, date, quantity_sold, units_wasted, quantity_on_hand, days_until_expiry
        FROM fbase"""),
    "features_temporal": stage(TEMPORAL),
    "features_lags": stage(LAGS),
    "features_rolling": stage(ROLLING),
    "features_product": stage(PRODUCT),
    "features_contextual": stage(CONTEXT),
    "features_derived": stage(DERIVED),
    "features_full": stage(list(FEATURE_COLUMNS), src="features"),
    "features_filled": with_features(
        "SELECT feature, round(median, 6) AS median, CAST(nulls_filled AS BIGINT) AS nulls_filled FROM ("
        + " UNION ALL ".join(
            f"SELECT '{c}' AS feature, (SELECT m_{c} FROM fmed) AS median, "
            f"count(*) FILTER (WHERE {c} IS NULL) AS nulls_filled FROM fraw" for c in FEATURE_COLUMNS)
        + ") t"),
}
