"""Registry entries for the operator modules (features, labels, scoring, rules, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS
from freshlane.functions.exprs import round6
from freshlane.operators import features as FE
from freshlane.plans.catalog import register

KEYS3 = ["store_id", "product_id", "date"]

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


def _stage(cols, filled=False):
    def q(ctx):
        df = ctx.features if filled else ctx.features_raw
        return df.select(*KEYS3, *[round6(c).alias(c) for c in cols])
    return q


register("feature_base_join", lambda ctx: FE.base_join(ctx.daily_sales, ctx.inventory_snapshots)
         .select(*KEYS3, "quantity_sold", "units_wasted", "quantity_on_hand", "days_until_expiry"))
register("features_temporal", _stage(TEMPORAL))
register("features_lags", _stage(LAGS))
register("features_rolling", _stage(ROLLING))
register("features_product", _stage(PRODUCT))
register("features_contextual", _stage(CONTEXT))
register("features_derived", _stage(DERIVED))
register("features_full", _stage(list(FEATURE_COLUMNS), filled=True))


def _features_filled(ctx):
    """F8 report: the median used per feature and how many NULLs it filled."""
    from freshlane.functions.quantiles import exact_median_row
    raw = ctx.features_raw
    med = exact_median_row(raw, FEATURE_COLUMNS)
    nulls = raw.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in FEATURE_COLUMNS])
    long_med = med.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("median")) for c in FEATURE_COLUMNS])).alias("m"))
    long_nul = nulls.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("nulls_filled")) for c in FEATURE_COLUMNS])).alias("n"))
    return (long_med.select("m.*").join(long_nul.select("n.*"), "feature")
            .select("feature", round6("median").alias("median"), F.col("nulls_filled").cast("long")))


register("features_filled", _features_filled)

# the rest of the operator families register themselves
from freshlane.plans import operator_queries_more  # noqa: E402,F401
