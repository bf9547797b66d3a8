"""View-level dataflow (V1..V27): what each dashboard page computes after its SQL.

Per-store pages are computed for every store at once (``store_id`` column).
Windows are partitioned by store and run over per-day aggregates, i.e. over
at most one row per calendar day and store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshlane.functions.exprs import avg1
from freshlane.functions.quantiles import exact_percentiles
from freshlane.plans import dashboard as D
from freshlane.plans.catalog import register

# Weekday names in display order (Monday first).
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# Waste impact constants (kg per unit, meals per kg, average unit cost).
KG_PER_UNIT, MEALS_PER_KG, AVG_UNIT_COST = 0.3, 2.5, 3.5


def _store_daily(ctx) -> DataFrame:
    return ctx.daily_sales.groupBy("store_id", "date").agg(
        F.sum("quantity_sold").alias("sold"), F.sum("units_wasted").alias("wasted"))


def trailing_full_mean(df: DataFrame, keys: list[str], order: str, col: str, k: int) -> DataFrame:
    """Mean of the last k rows including the current one; NULL until k rows exist (rolling(k))."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(k - 1), 0)
    return df.withColumn("ma", F.when(F.count(col).over(w) == k, F.avg(col).over(w)))


def waste_moving_avg(ctx) -> DataFrame:  # V1
    """7-row mean of daily waste including today; NULL until 7 rows exist."""
    d = trailing_full_mean(_store_daily(ctx), ["store_id"], "date", "wasted", 7)
    return d.select("store_id", "date", F.col("wasted").cast("long"), F.round("ma", 6).alias("waste_ma7"))


def waste_by_weekday(ctx) -> DataFrame:  # V2
    """Mean daily waste per weekday name, Monday..Sunday, missing weekday -> NULL."""
    d = D.daily_metrics(ctx).withColumn("day_index", F.weekday("date"))
    g = d.groupBy("day_index").agg(F.avg("wasted").alias("avg_waste"))
    days = (ctx.stores.limit(1).select(F.posexplode(F.array(*[F.lit(x) for x in WEEKDAYS])))
            .select(F.col("pos").alias("day_index"), F.col("col").alias("day_name")))
    return days.join(g, "day_index", "left").select("day_index", "day_name",
                                                    F.round("avg_waste", 6).alias("avg_waste"))


def waste_impact(ctx) -> DataFrame:  # V3
    g = _store_daily(ctx).groupBy("store_id").agg(F.sum("wasted").alias("w"), F.sum("sold").alias("s"))
    kg = F.col("w") * F.lit(KG_PER_UNIT)
    return g.select("store_id", F.col("w").cast("long").alias("total_wasted"), F.col("s").cast("long").alias("total_sold"),
                    F.round(F.col("w") / F.greatest(F.col("s"), F.lit(1)) * 100, 6).alias("waste_rate"),
                    F.round(kg, 6).alias("est_kg"), (kg * F.lit(MEALS_PER_KG)).cast("long").alias("est_meals"),
                    F.round(F.col("w") * F.lit(AVG_UNIT_COST), 6).alias("est_cost"))


def savings_projection(ctx) -> DataFrame:  # V4
    """Saved units int(w * pct / 100) and cost for reduction targets 5..50 % (step 5)."""
    g = _store_daily(ctx).groupBy("store_id").agg(F.sum("wasted").alias("w"))
    t = g.select("store_id", "w", F.explode(F.sequence(F.lit(5), F.lit(50), F.lit(5))).alias("target_pct"))
    units = (F.col("w") * F.col("target_pct") / 100).cast("long")
    return t.select("store_id", F.col("target_pct").cast("int"), units.alias("saved_units"),
                    F.round(units * F.lit(AVG_UNIT_COST), 6).alias("saved_cost"))


def _demand(ctx) -> DataFrame:
    return D.demand_vs_prediction(ctx)


def forecast_kpis(ctx) -> DataFrame:  # V5
    d = _demand(ctx)
    m = d.where(F.col("predicted").isNotNull() & F.col("actual").isNotNull())
    err = F.col("predicted") - F.col("actual")
    k = m.groupBy("store_id").agg(
        F.avg(F.abs(err) / F.greatest(F.col("actual"), F.lit(1))).alias("mape"), F.avg(err).alias("bias"),
        F.count(F.lit(1)).alias("n"))
    prods = d.groupBy("store_id").agg(F.count_distinct("product_id").alias("products"))
    return prods.join(k, "store_id", "left").select(
        "store_id", F.round("mape", 6).alias("mape"), F.round("bias", 6).alias("bias"),
        F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("predictions"), F.col("products").cast("long"))


def demand_window_clamped(ctx, date_from=None, date_to=None) -> DataFrame:  # V6
    """Requested window clamped to [first date + 30 days, last date] (warm-up trimmed)."""
    s = ctx.daily_sales
    b = s.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    lo = F.date_add(b.select("lo").scalar(), 30)
    hi = b.select("hi").scalar()
    f = F.greatest(lo, F.lit(date_from).cast("date")) if date_from else lo
    t = F.least(hi, F.lit(date_to).cast("date")) if date_to else hi
    return _demand(ctx).where((F.col("date") >= f) & (F.col("date") <= t))


def daily_demand_totals(ctx) -> DataFrame:  # V7
    """Per store and day: sums where an all-NULL day gives 0 (pandas sum)."""
    g = demand_window_clamped(ctx).groupBy("store_id", "date").agg(
        F.sum("actual").alias("actual"), F.sum("predicted").alias("predicted"),
        F.sum("confidence_lower").alias("lower"), F.sum("confidence_upper").alias("upper"))
    return g.select("store_id", "date", F.coalesce("actual", F.lit(0)).cast("long").alias("actual"),
                    *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("predicted", "lower", "upper")])


def product_demand_series(ctx) -> DataFrame:  # V8
    return (demand_window_clamped(ctx)
            .select("store_id", "product_id", "date", "actual", "predicted", "confidence_lower", "confidence_upper")
            .orderBy("store_id", "product_id", "date"))


def top_products_volume(ctx, k: int = 15) -> DataFrame:  # V9
    g = demand_window_clamped(ctx).groupBy("store_id", "product_name").agg(
        F.sum("actual").alias("total"), F.count("actual").alias("n"))
    w = Window.partitionBy("store_id").orderBy(F.desc("total"), "product_name")
    return (g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("store_id", "product_name", F.col("total").cast("long"),
                    avg1("total", "n").alias("avg_daily"), F.col("rank").cast("int")))


def _snapshot(ctx) -> DataFrame:
    return D.inventory_snapshot(ctx).withColumn("exp", F.coalesce(F.col("days_until_expiry"), F.lit(999)))


def inventory_health(ctx) -> DataFrame:  # V10
    s = _snapshot(ctx)
    return s.groupBy("store_id").agg(
        F.count(F.lit(1)).cast("long").alias("total_skus"),
        F.count_if(F.col("exp") <= 2).cast("long").alias("critical"),
        F.count_if((F.col("exp") > 2) & (F.col("exp") <= 5)).cast("long").alias("warning"),
        F.count_if(F.col("quantity_on_hand") < F.col("reorder_point")).cast("long").alias("below_reorder"))


def inventory_alerts(ctx) -> DataFrame:  # V10, store-overview variant (<= 3 days)
    s = _snapshot(ctx)
    return s.groupBy("store_id").agg(
        F.count_if(F.col("days_until_expiry").isNotNull() & (F.col("days_until_expiry") <= 3))
        .cast("long").alias("expiring_soon"),
        F.count_if(F.col("quantity_on_hand") < F.col("reorder_point")).cast("long").alias("below_reorder"))


def category_expiry(ctx) -> DataFrame:  # V11
    s = _snapshot(ctx).where(F.col("exp") < 999)
    return s.groupBy("store_id", "category").agg(
        F.round(F.avg("exp"), 6).alias("avg_expiry"), F.sum("quantity_on_hand").cast("long").alias("total_stock"),
        F.count(F.lit(1)).cast("long").alias("items"))


def critical_items_loss(ctx) -> DataFrame:  # V12
    s = _snapshot(ctx).where(F.col("exp") <= 2)
    return (s.select("store_id", "product_id", "product", "quantity_on_hand", "days_until_expiry",
                     F.round(F.col("quantity_on_hand") * F.col("unit_price"), 6).alias("est_loss"))
            .orderBy("store_id", F.desc("est_loss"), "product_id"))


def stock_vs_reorder(ctx, k: int = 25) -> DataFrame:  # V13
    w = Window.partitionBy("store_id").orderBy(F.asc_nulls_last("days_until_expiry"), "product_id")
    s = D.inventory_snapshot(ctx).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    return s.select("store_id", "product_id", "product", "quantity_on_hand", "reorder_point",
                    F.col("rn").cast("int").alias("row_no"))


def _histogram(df: DataFrame, keys: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width bins over each key's min..max (last bin closed); per-bin counts.

    With keys the per-key bounds (one row per key) are broadcast; without keys
    the two bounds are scalar subqueries (no join)."""
    if keys:
        st = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        j = df.join(F.broadcast(st), keys)
    else:
        b = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        j = df.withColumns({"lo": b.select("lo").scalar(), "hi": b.select("hi").scalar()})
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(value) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1)))
    return j.groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).cast("long").alias("count"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi")).select(
        *keys, "bin", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins, 6).alias("bin_start"),
        "count")


def expiry_histogram(ctx) -> DataFrame:  # V14
    s = _snapshot(ctx).where(F.col("days_until_expiry").isNotNull()).withColumn(
        "v", F.col("days_until_expiry").cast("double"))
    return _histogram(s, ["store_id"], "v", 20)


def accuracy_summary(ctx) -> DataFrame:  # V15
    a = D.prediction_accuracy(ctx)
    return a.agg(F.round(F.avg("mape"), 6).alias("avg_mape"),
                 F.min_by("date", F.struct("mape", "date")).alias("best_day"),
                 F.max_by("date", F.struct("mape", F.negative(F.datediff("date", F.lit("2000-01-01")))))
                 .alias("worst_day"),
                 F.count("actual").cast("long").alias("days"))


def accuracy_bands(ctx) -> DataFrame:  # V16
    band = (F.when(F.col("mape") < 5, "< 5%").when(F.col("mape") < 10, "5-10%")
             .when(F.col("mape") < 20, "10-20%").otherwise("> 20%"))
    return D.prediction_accuracy(ctx).groupBy(band.alias("error_band")).agg(
        F.count(F.lit(1)).cast("long").alias("days"))


def mape_histogram(ctx) -> DataFrame:  # V17
    a = D.prediction_accuracy(ctx).where(F.col("mape").isNotNull())
    return _histogram(a, [], "mape", 25)


def alert_levels(ctx) -> DataFrame:  # V18
    a = D.recent_alerts(ctx)
    lvl = F.when(F.col("severity") == "critical", "critical").when(F.col("severity") == "warning", "warning") \
        .otherwise("info")
    return a.select("alert_type", "severity", lvl.alias("level"), "message", "created_at")


def catalog(ctx, store_id=None) -> DataFrame:  # V19
    s = D.product_sales(ctx, store_id)
    p = D.products_list(ctx).select("product_id", "name", "unit_price", "cost_price", "shelf_life_days",
                                    "storage_temp", "category", "perishability")
    j = p.join(s.select("product_id", "total_sold", "total_revenue", "total_wasted", "avg_daily_sold"),
               "product_id", "left")
    return j.select("product_id", "name", "category", "storage_temp", "perishability", "unit_price", "cost_price",
                    F.coalesce("total_sold", F.lit(0)).cast("long").alias("total_sold"),
                    F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
                    F.coalesce("total_wasted", F.lit(0)).cast("long").alias("total_wasted"),
                    F.coalesce("avg_daily_sold", F.lit(0.0)).alias("avg_daily_sold"))


def catalog_filtered(ctx, category="All", storage="cold", perishability="All") -> DataFrame:  # V20
    c = catalog(ctx)
    for col_name, v in (("category", category), ("storage_temp", storage), ("perishability", perishability)):
        if v != "All":
            c = c.where(F.col(col_name) == v)
    return c


def catalog_totals(ctx) -> DataFrame:  # V21
    return catalog(ctx).agg(F.count(F.lit(1)).cast("long").alias("products"),
                            F.sum("total_sold").cast("long").alias("units_sold"),
                            F.round(F.sum("total_revenue"), 2).alias("revenue"),
                            F.sum("total_wasted").cast("long").alias("units_wasted"))


def catalog_category_sales(ctx) -> DataFrame:  # V21
    return catalog(ctx).groupBy("category").agg(F.sum("total_sold").cast("long").alias("total_sold"),
                                                F.round(F.sum("total_revenue"), 2).alias("total_revenue"))


def catalog_top10(ctx) -> DataFrame:  # V21
    return catalog(ctx).orderBy(F.desc("total_sold"), "product_id").limit(10).select(
        "product_id", "name", "total_sold")


def margin_bands(ctx) -> DataFrame:  # V22
    p = ctx.products
    m = (p.unit_price - p.cost_price) / p.unit_price * 100
    band = F.when(m > 30, "high").when(m > 15, "medium").otherwise("low")
    return p.select("product_id", F.round(m.cast("double"), 6).alias("margin_pct"), band.alias("margin_band"))


def _recs(ctx) -> DataFrame:
    return D.recommendations_recent(ctx)


def recommendation_kpis(ctx) -> DataFrame:  # V23
    r = _recs(ctx)
    g = r.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "pending").alias("pending"),
        F.count_if(F.col("status") == "accepted").alias("accepted"),
        F.sum(F.col("expected_cost_saved_usd").cast("decimal(12,2)")).alias("expected"),
        F.sum(F.coalesce(F.col("actual_cost_saved_usd").cast("decimal(12,2)"), F.lit(0))).alias("realized"))
    return g.select("store_id", F.col("total").cast("long"), F.col("pending").cast("long"),
                    F.col("accepted").cast("long"),
                    F.round(F.col("accepted") / F.greatest(F.col("total"), F.lit(1)), 6).alias("accept_rate"),
                    F.col("expected").cast("double").alias("expected_savings"),
                    F.col("realized").cast("double").alias("realized_savings"))


def recs_by_action(ctx) -> DataFrame:  # V24
    return _recs(ctx).groupBy("store_id", "action_type").agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.col("expected_cost_saved_usd").cast("decimal(12,2)")).cast("double").alias("savings"))


def recs_by_status(ctx) -> DataFrame:  # V24
    return _recs(ctx).groupBy("store_id", "status").agg(F.count(F.lit(1)).cast("long").alias("n"))


def recs_priority_tiers(ctx) -> DataFrame:  # V25
    """p25 / p75 of expected savings per store page (exact, interpolated), then tiers."""
    r = _recs(ctx).select("store_id", "rec_id", F.col("expected_cost_saved_usd").alias("v"))
    q = exact_percentiles(r, ["store_id"], "v", [0.25, 0.75])
    qq = q.groupBy("store_id").agg(F.max(F.when(F.col("prob") == 0.25, F.col("value"))).alias("p25"),
                                   F.max(F.when(F.col("prob") == 0.75, F.col("value"))).alias("p75"))
    j = r.join(F.broadcast(qq), "store_id")
    tier = F.when(F.col("v") >= F.col("p75"), "high").when(F.col("v") >= F.col("p25"), "medium").otherwise("low")
    return j.select("store_id", "rec_id", tier.alias("urgency"))


def cumulative_savings(ctx) -> DataFrame:  # V26
    r = _recs(ctx).where(F.col("status") == "accepted")
    g = r.groupBy("store_id", "date").agg(
        F.sum(F.col("expected_cost_saved_usd").cast("decimal(12,2)")).alias("expected"),
        F.sum(F.col("actual_cost_saved_usd").cast("decimal(12,2)")).alias("actual"))
    w = Window.partitionBy("store_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("store_id", "date", F.col("expected").cast("double"), F.col("actual").cast("double"),
                    F.sum("expected").over(w).cast("double").alias("cumulative_expected"),
                    F.sum("actual").over(w).cast("double").alias("cumulative_actual"))


for _k, _f in [
    ("waste_moving_avg", waste_moving_avg), ("waste_by_weekday", waste_by_weekday), ("waste_impact", waste_impact),
    ("savings_projection", savings_projection), ("forecast_kpis", forecast_kpis),
    ("demand_window_clamped", demand_window_clamped), ("daily_demand_totals", daily_demand_totals),
    ("product_demand_series", product_demand_series), ("top_products_volume", top_products_volume),
    ("inventory_health", inventory_health), ("inventory_alerts", inventory_alerts),
    ("category_expiry", category_expiry), ("critical_items_loss", critical_items_loss),
    ("stock_vs_reorder", stock_vs_reorder), ("expiry_histogram", expiry_histogram),
    ("accuracy_summary", accuracy_summary), ("accuracy_bands", accuracy_bands), ("mape_histogram", mape_histogram),
    ("alert_levels", alert_levels), ("catalog", catalog), ("catalog_filtered", catalog_filtered),
    ("catalog_totals", catalog_totals), ("catalog_category_sales", catalog_category_sales),
    ("catalog_top10", catalog_top10), ("margin_bands", margin_bands), ("recommendation_kpis", recommendation_kpis),
    ("recs_by_action", recs_by_action), ("recs_by_status", recs_by_status),
    ("recs_priority_tiers", recs_priority_tiers), ("cumulative_savings", cumulative_savings),
]:
    register(_k, _f)
