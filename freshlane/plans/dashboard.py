"""Dashboard queries (D1..D17) and inventory API queries (I1..I5).

``store_id`` None means all stores, as in the dashboard. Queries the dashboard
asks per store (inventory snapshot, recommendations, top sellers) are computed
for every store at once, keyed by ``store_id``: one job instead of one per store.

Dimensions (stores, categories, products) are bounded by construction
(regions, 6 types x 25 brands) and are broadcast; facts are aggregated with
map-side partial aggregation before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshlane.functions.exprs import avg1, pct1


def _sales(ctx, store_id=None) -> DataFrame:
    s = ctx.daily_sales
    return s.where(F.col("store_id") == store_id) if store_id else s


def _product_dim(ctx) -> DataFrame:
    """products ⋈ categories: <=150 rows, broadcast."""
    c = ctx.categories.select("category_id", F.col("name").alias("category"), "perishability")
    return F.broadcast(ctx.products.join(F.broadcast(c), "category_id"))


def stores_list(ctx) -> DataFrame:  # D1
    return ctx.stores.select("store_id", "name", "location", "size_sqft", "type").orderBy("store_id")


def categories_list(ctx) -> DataFrame:  # D2
    return ctx.categories.select("category_id", "name", "perishability", "avg_shelf_days").orderBy("name")


def products_list(ctx) -> DataFrame:  # D3
    return (_product_dim(ctx)
            .select("product_id", "name", F.col("unit_price").cast("double").alias("unit_price"),
                    F.col("cost_price").cast("double").alias("cost_price"), "shelf_life_days",
                    "storage_temp", "category", "perishability")
            .orderBy("name"))


def date_range(ctx) -> DataFrame:  # D4
    return ctx.daily_sales.agg(F.min("date").alias("min_d"), F.max("date").alias("max_d"))


def kpi_summary(ctx, store_id=None) -> DataFrame:  # D5
    g = _sales(ctx, store_id).agg(
        F.count_distinct("store_id").alias("stores"),
        F.count_distinct("product_id").alias("products"),
        F.sum("quantity_sold").alias("total_sold"),
        F.sum("revenue").alias("total_revenue"),
        F.sum("units_wasted").alias("total_wasted"),
        F.sum("units_donated").alias("total_donated"),
        F.count_distinct("date").alias("days_tracked"))
    return g.select(
        F.col("stores").cast("long"), F.col("products").cast("long"),
        F.col("total_sold").cast("long"), F.col("total_revenue").cast("double"),
        F.col("total_wasted").cast("long"), F.col("total_donated").cast("long"),
        pct1("total_wasted", "total_sold").alias("waste_pct"),
        F.col("days_tracked").cast("long"))


def daily_metrics(ctx, store_id=None) -> DataFrame:  # D6
    return (_sales(ctx, store_id).groupBy("date")
            .agg(F.sum("quantity_sold").cast("long").alias("sold"),
                 F.sum("revenue").cast("double").alias("revenue"),
                 F.sum("units_wasted").cast("long").alias("wasted"))
            .orderBy("date"))


def waste_by_category(ctx, store_id=None) -> DataFrame:  # D7
    s = _sales(ctx, store_id).join(_product_dim(ctx).select("product_id", "category"), "product_id")
    g = s.groupBy("category").agg(F.sum("units_wasted").alias("wasted"),
                                  F.sum("quantity_sold").alias("sold"))
    return (g.select("category", F.col("wasted").cast("long"), F.col("sold").cast("long"),
                     pct1("wasted", "sold").alias("waste_rate"))
            .orderBy(F.desc("wasted"), "category"))


def top_wasted_products(ctx, store_id=None, limit: int = 10) -> DataFrame:  # D8 (V27: k = 8/10/15)
    s = _sales(ctx, store_id).join(
        _product_dim(ctx).select("product_id", F.col("name").alias("product"), "category", "unit_price"),
        "product_id")
    g = s.groupBy("product", "category", "unit_price").agg(
        F.sum("units_wasted").alias("wasted"), F.sum("quantity_sold").alias("sold"))
    return (g.select("product", "category", F.col("wasted").cast("long"), F.col("sold").cast("long"),
                     F.round(F.col("unit_price") * F.col("wasted"), 2).cast("double").alias("waste_cost"))
            .orderBy(F.desc("wasted"), "product").limit(limit))


def _last_snapshot(ctx, store_id=None) -> DataFrame:
    """Rows of each store's last inventory date (A6 per store: tiny agg, broadcast back)."""
    inv = ctx.inventory_snapshots
    if store_id:
        inv = inv.where(F.col("store_id") == store_id)
    last = inv.groupBy("store_id").agg(F.max("date").alias("date"))
    return inv.join(F.broadcast(last), ["store_id", "date"])


def inventory_snapshot(ctx, store_id=None) -> DataFrame:  # D9
    i = _last_snapshot(ctx, store_id).join(_product_dim(ctx), "product_id")
    return (i.select("store_id", "product_id", F.col("name").alias("product"), "category",
                     "quantity_on_hand", "days_until_expiry", "reorder_point", "last_delivery_date",
                     "shelf_life_days", F.col("unit_price").cast("double").alias("unit_price"))
            .orderBy("store_id", F.asc_nulls_last("days_until_expiry"), "product_id"))


def demand_vs_prediction(ctx, store_id=None, date_from=None, date_to=None, category=None) -> DataFrame:  # D10
    s = _sales(ctx, store_id)
    if date_from:
        s = s.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to:
        s = s.where(F.col("date") <= F.lit(date_to).cast("date"))
    s = s.join(_product_dim(ctx).select("product_id", F.col("name").alias("product_name"), "category"),
               "product_id")
    if category:
        s = s.where(F.col("category") == category)
    p = ctx.predictions.select("store_id", "product_id", "date", "predicted_demand",
                               "confidence_lower", "confidence_upper")
    j = s.join(p, ["store_id", "product_id", "date"], "left")
    return (j.select("store_id", "date", "product_id", "product_name", "category",
                     F.col("quantity_sold").cast("long").alias("actual"),
                     F.col("predicted_demand").cast("double").alias("predicted"),
                     F.col("confidence_lower").cast("double").alias("confidence_lower"),
                     F.col("confidence_upper").cast("double").alias("confidence_upper")))


def recommendations_recent(ctx, store_id=None, limit: int = 200) -> DataFrame:  # D11
    r = ctx.recommendations_log
    if store_id:
        r = r.where(F.col("store_id") == store_id)
    w = Window.partitionBy("store_id").orderBy(F.desc("created_at"), F.desc("rec_id"))
    top = r.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    j = top.join(_product_dim(ctx).select("product_id", F.col("name").alias("product"), "category"),
                 "product_id")
    return j.select("store_id", "rec_id", "date", "product_id", "product", "category", "action_type",
                    "markdown_pct", "expected_waste_reduction",
                    F.col("expected_cost_saved_usd").cast("double").alias("expected_cost_saved_usd"),
                    "status", "actual_waste_reduction",
                    F.col("actual_cost_saved_usd").cast("double").alias("actual_cost_saved_usd"),
                    "created_at")


def product_sales(ctx, store_id=None) -> DataFrame:  # D12
    """Every product, with its sales (NULL when never sold) in the store (or all stores)."""
    s = _sales(ctx, store_id).groupBy("product_id").agg(
        F.sum("quantity_sold").alias("total_sold"), F.sum("revenue").alias("total_revenue"),
        F.sum("units_wasted").alias("total_wasted"), F.count("quantity_sold").alias("n"),
        F.count_distinct("date").alias("days_on_shelf"))
    j = _product_dim(ctx).join(s, "product_id", "left")
    return (j.select("product_id", F.col("name").alias("product"), "category",
                     F.col("total_sold").cast("long"), F.col("total_revenue").cast("double"),
                     F.col("total_wasted").cast("long"),
                     avg1("total_sold", "n").alias("avg_daily_sold"),
                     F.coalesce(F.col("days_on_shelf"), F.lit(0)).cast("long").alias("days_on_shelf"))
            .orderBy(F.desc_nulls_last("total_sold"), "product_id"))


def recent_alerts(ctx, limit: int = 30) -> DataFrame:  # D13
    return (ctx.alerts.orderBy(F.desc("created_at"), F.desc("alert_id")).limit(limit)
            .select("alert_type", "severity", "message", "created_at"))


def feature_store_stats(ctx) -> DataFrame:  # D14
    fs = ctx.feature_store
    return fs.agg(F.count(F.lit(1)).alias("total_rows"),
                  F.count_distinct("product_id").alias("products"),
                  F.count_distinct("store_id").alias("stores"),
                  F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def prediction_accuracy(ctx, store_id=None) -> DataFrame:  # D15
    s = _sales(ctx, store_id).where(F.col("quantity_sold") > 0)
    p = ctx.predictions.where(F.col("predicted_demand").isNotNull())
    j = s.join(p.select("store_id", "product_id", "date", "predicted_demand"),
               ["store_id", "product_id", "date"])
    ape = F.abs(F.col("predicted_demand").cast("double") - F.col("quantity_sold")) \
        / F.col("quantity_sold") * 100
    return (j.groupBy("date")
            .agg(F.sum("quantity_sold").cast("long").alias("actual"),
                 F.sum("predicted_demand").cast("double").alias("predicted"),
                 F.round(F.avg(ape), 1).alias("mape"))
            .orderBy("date"))


def store_comparison(ctx) -> DataFrame:  # D16
    g = ctx.daily_sales.groupBy("store_id").agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity_sold").alias("units_sold"),
        F.sum("units_wasted").alias("units_wasted"), F.count_distinct("product_id").alias("products"))
    j = F.broadcast(ctx.stores).join(g, "store_id")
    return (j.select("store_id", "name", "location", "type", F.col("revenue").cast("double"),
                     F.col("units_sold").cast("long"), F.col("units_wasted").cast("long"),
                     pct1("units_wasted", "units_sold").alias("waste_pct"),
                     F.col("products").cast("long"))
            .orderBy(F.desc("revenue"), "store_id"))


def top_sellers(ctx, store_id=None, limit: int = 10) -> DataFrame:  # D17, per store
    s = _sales(ctx, store_id).groupBy("store_id", "product_id").agg(
        F.sum("quantity_sold").alias("sold"), F.sum("revenue").alias("revenue"))
    j = s.join(_product_dim(ctx).select("product_id", F.col("name").alias("product"), "category"),
               "product_id")
    w = Window.partitionBy("store_id").orderBy(F.desc("sold"), "product")
    return (j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
            .select("store_id", "product", "category", F.col("sold").cast("long"),
                    F.col("revenue").cast("double"), F.col("rank").cast("int")))


# ---- inventory API (I1..I5) -------------------------------------------------------------

def inventory_page(ctx, store_id=None, product_id=None, limit: int = 50, offset: int = 0) -> DataFrame:  # I1
    """Last snapshot of each store, ordered by expiry (NULLS LAST), one page per store."""
    i = _last_snapshot(ctx, store_id)
    if product_id:
        i = i.where(F.col("product_id") == product_id)
    j = i.join(_product_dim(ctx), "product_id")
    w = Window.partitionBy("store_id").orderBy(F.asc_nulls_last("days_until_expiry"), "product_id")
    ranked = j.withColumn("_rn", F.row_number().over(w))
    page = ranked.where((F.col("_rn") > offset) & (F.col("_rn") <= offset + limit))
    return page.select("store_id", "product_id", F.col("name").alias("product_name"), "category",
                       "quantity_on_hand", "days_until_expiry", "reorder_point",
                       F.col("unit_price").cast("double").alias("unit_price"),
                       F.col("_rn").cast("int").alias("row_no"))


def inventory_total(ctx, store_id=None) -> DataFrame:  # I2
    return (_last_snapshot(ctx, store_id).groupBy("store_id")
            .agg(F.count(F.lit(1)).cast("long").alias("total")))
