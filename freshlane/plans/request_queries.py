"""Registry entries: posted lists (Q8), missing features (A8), one store's product tables (D12, V19), fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshlane.functions.exprs import round6
from freshlane.operators import quantile_models as QM
from freshlane.operators import requests as RQ
from freshlane.operators import rules as R
from freshlane.operators.asof import unmatched_requests
from freshlane.plans import dashboard as D
from freshlane.plans import views as V
from freshlane.plans.catalog import register

STORE = 2


def _lists(ctx):
    """One posted list per day of sales: the day's snapshots, every seventh product's stock below 0 in odd weeks."""
    week = F.floor(F.datediff("date", F.lit("1970-01-05")) / 7)
    stock = F.col("current_stock") - F.when((F.col("product_id") % 7 == 0) & (week % 2 == 1), 1000).otherwise(0)
    return RQ.list_validity(ctx.daily_sales.select("date"), R.waste_requests(ctx).withColumn("current_stock", stock), ["date"])


def _unknown(ctx):
    """Every sale asked again, a copy of each for a product 100,000 further on and one for a store that does not exist."""
    asked = ctx.daily_sales.select("store_id", "product_id", "date")
    return asked.unionByName(asked.withColumn("product_id", F.col("product_id") + 100000)).unionByName(
        asked.withColumn("store_id", -F.col("store_id")))


def _served(ctx):
    return (RQ.served_or_missing(_unknown(ctx), ctx.features, ["store_id", "product_id"])
            .groupBy("date", "found").agg(F.count(F.lit(1)).cast("long").alias("requests")))


register("request_lists_accepted", lambda ctx: _lists(ctx)[0].select(
    "store_id", "product_id", "date", "current_stock", "days_until_expiry"))
register("request_lists_refused", lambda ctx: _lists(ctx)[1])
register("requests_not_found", lambda ctx: unmatched_requests(_unknown(ctx), ctx.features, ["store_id", "product_id"]).select(
    "store_id", "product_id", "date"))
register("requests_served", _served)
register("product_sales_store", lambda ctx: D.product_sales(ctx, STORE))
register("catalog_store", lambda ctx: V.catalog(ctx, STORE))
register("waste_risk_report_ml", lambda ctx: RQ.fitted_waste_report(
    R.waste_requests(ctx), ctx.features, *ctx.ml.fitted("demand", "waste")))
register("score_demand_quantiles", lambda ctx: QM.score_quantiles(ctx.ml["quantiles"], ctx.ml["data"]).select(
    "store_id", "product_id", "date", round6("confidence_lower").alias("confidence_lower"),
    round6("confidence_upper").alias("confidence_upper")))
