"""Waste-risk request scoring and the recommendation rules (C1..C13).

All pairs are scored in one job. The five actions are expanded with a
fixed-size ``explode`` (no join, no pair explosion: at most 5 rows per pair),
filtered by the inclusive risk range, priced in DECIMAL, and ranked with a
``row_number`` over (store, product) — a group of at most 5 rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshlane.functions.exprs import idiv, markdown_pct, risk_tier, to_dec
from freshlane.operators.asof import latest_by, nearest
from freshlane.operators.scoring import waste_score

KEYS = ["store_id", "product_id"]

# The five actions (name, inclusive risk range, confidence base,
# description template) in their evaluation order.
ACTIONS = (
    ("adjust_order", 0.2, 1.0, "0.90", "Reduce next order by {reduction} units (from {current} to {target})"),
    ("markdown", 0.4, 1.0, "0.80", "Apply {pct}% markdown to {product_name}"),
    ("bundle", 0.3, 0.8, "0.65", "Create bundle: {product_name} + complementary item at 15% off"),
    ("redistribute", 0.5, 1.0, "0.70", "Transfer {units} units to higher-demand store"),
    ("donate", 0.7, 1.0, "0.95", "Donate {units} units of {product_name} to local food bank"),
)
MONEY = "decimal(12,2)"


def _action_array() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("action_ord"), F.lit(name).alias("action"),
                 F.lit(lo).alias("min_risk"), F.lit(hi).alias("max_risk"),
                 F.lit(base).cast("decimal(3,2)").alias("confidence_base"))
        for i, (name, lo, hi, base, _t) in enumerate(ACTIONS)])


def engine_excess(stock: Column, demand: Column) -> Column:
    """max(0, int(stock - demand)) (truncation after the subtraction)."""
    return F.greatest(F.lit(0), (stock.cast("double") - demand.cast("double")).cast("int"))


def route_excess(stock: Column, demand: Column) -> Column:
    """max(0, stock - int(demand)) (truncation of the demand first)."""
    return F.greatest(F.lit(0), stock.cast("int") - demand.cast("double").cast("int"))


def _finish_inputs(j: DataFrame) -> DataFrame:
    return j.select(
        *KEYS, "date", "product_name", "unit_price", "cost_price",
        to_dec(F.col("predicted_demand"), 16, 6).alias("predicted_demand"),
        to_dec(F.col("risk"), 16, 6).alias("waste_risk_score"),
        F.coalesce(F.col("quantity_on_hand"), F.lit(0)).cast("int").alias("current_stock"),
        F.when(F.col("inv_date").isNull(), F.lit(7))
         .otherwise(F.coalesce(F.nullif(F.col("days_until_expiry"), F.lit(0)), F.lit(7)))
         .cast("int").alias("days_until_expiry"))


def _products(ctx) -> DataFrame:
    return F.broadcast(ctx.products.select("product_id", F.col("name").alias("product_name"),
                                           "unit_price", "cost_price"))


def recommendation_inputs(ctx) -> DataFrame:
    """C4 inputs for every pair (the recommend API): latest inventory (stock 0 /
    expiry 7 when missing, expiry NULL or 0 -> 7), latest feature row, product, scores."""
    from freshlane.operators.scoring import demand_point, waste_score
    inv = latest_by(ctx.inventory_snapshots.select(*KEYS, "date", "quantity_on_hand", "days_until_expiry"),
                    KEYS, "date").withColumnRenamed("date", "inv_date")
    f = ctx.features
    scored = f.select(*KEYS, "date", demand_point(f).alias("predicted_demand"), waste_score().alias("risk"))
    lf = latest_by(scored, KEYS, "date")
    return _finish_inputs(lf.join(inv, KEYS, "left").join(_products(ctx), "product_id"))


def recommendation_inputs_daily(ctx) -> DataFrame:
    """Daily batch: every scored (store, product, day) with the inventory as of that day
    (backward as-of over the union of features and snapshots: one shuffle on the pair)."""
    from freshlane.operators.asof import asof_backward
    from freshlane.operators.scoring import demand_point, waste_score
    f = ctx.features
    scored = f.select(*KEYS, "date", demand_point(f).alias("predicted_demand"), waste_score().alias("risk"))
    j = asof_backward(scored, ctx.inventory_snapshots, KEYS, "date", "date",
                      ["quantity_on_hand", "days_until_expiry"]).withColumnRenamed("matched_date", "inv_date")
    return _finish_inputs(j.join(_products(ctx), "product_id"))


def action_candidates(inputs: DataFrame) -> DataFrame:
    """Eligible actions by inclusive risk range; C6: pairs without excess get none."""
    risk = F.col("waste_risk_score")
    e = inputs.withColumn("excess", engine_excess(F.col("current_stock"), F.col("predicted_demand")))
    return (e.select("*", F.explode(_action_array()).alias("_a")).select("*", "_a.*").drop("_a")
            .where((risk >= F.col("min_risk")) & (risk <= F.col("max_risk")) & (F.col("excess") > 0)))


def action_impacts(cands: DataFrame) -> DataFrame:
    """Units, revenue impact, cost saved and description per action."""
    risk = F.col("waste_risk_score")
    excess = F.col("excess")
    waste_units = F.greatest(F.lit(1), (excess * risk).cast("int"))
    pct = markdown_pct(risk, F.col("days_until_expiry"))
    price, cost = F.col("unit_price"), F.col("cost_price")
    a = F.col("action")
    md_units = F.least(F.col("_w"), idiv(F.col("_w") * (F.col("_pct") + 50), F.lit(100)))
    units = (F.when(a == "markdown", md_units)
              .when(a == "bundle", F.greatest(F.lit(1), idiv(F.col("_w"), F.lit(2))))
              .when(a == "donate", F.greatest(F.lit(1), F.col("_w")))
              .when(a == "adjust_order", F.greatest(F.lit(1), excess))
              .when(a == "redistribute", F.greatest(F.lit(1), idiv(excess, F.lit(2)))))
    u = F.col("waste_reduction_units")
    loss = (F.when(a == "markdown", -F.round(u * price * F.col("_pct") / 100, 2))
             .when(a == "bundle", -F.round(u * price * F.lit(0.15).cast("decimal(3,2)"), 2))
             .otherwise(F.lit(0)))
    target = F.greatest(F.lit(0), F.col("current_stock") - u)
    desc = (F.when(a == "adjust_order", F.format_string(
                "Reduce next order by %d units (from %d to %d)", u, F.col("current_stock"), target))
             .when(a == "markdown", F.format_string("Apply %d%% markdown to %s", F.col("_pct"),
                                                    F.col("product_name")))
             .when(a == "bundle", F.format_string("Create bundle: %s + complementary item at 15%% off",
                                                  F.col("product_name")))
             .when(a == "redistribute", F.format_string("Transfer %d units to higher-demand store", u))
             .when(a == "donate", F.format_string("Donate %d units of %s to local food bank", u,
                                                  F.col("product_name"))))
    half = F.lit("0.5").cast("decimal(2,1)")
    conf = F.round(F.least(F.lit(1).cast("decimal(3,2)"), F.col("confidence_base") * (half + half * risk)), 2)
    return (cands.withColumn("_w", waste_units).withColumn("_pct", pct)
            .withColumn("waste_reduction_units", units.cast("int"))
            .withColumn("markdown_pct", F.when(a == "markdown", F.col("_pct")).otherwise(F.lit(0)).cast("int"))
            .withColumn("revenue_impact_usd", loss.cast(MONEY))
            .withColumn("waste_cost_saved_usd", F.round(u * cost, 2).cast(MONEY))
            .withColumn("description", desc)
            .withColumn("confidence", conf.cast("decimal(4,2)"))
            .drop("_w", "_pct"))


def ranked_recommendations(impacts: DataFrame) -> DataFrame:
    """Priority 1.. by cost saved desc, ties in action order (stable sort)."""
    w = Window.partitionBy(*KEYS, "date").orderBy(F.desc("waste_cost_saved_usd"), "action_ord")
    return impacts.withColumn("priority", F.row_number().over(w).cast("int"))


def recommendations(ctx) -> DataFrame:
    """C4: the recommend job for all pairs (latest state of each pair)."""
    return ranked_recommendations(action_impacts(action_candidates(recommendation_inputs(ctx))))


def recommendations_daily(ctx) -> DataFrame:
    """The daily batch: ranked actions for every scored day of every pair."""
    r = ranked_recommendations(action_impacts(action_candidates(recommendation_inputs_daily(ctx))))
    return r


REC_COLUMNS = ["store_id", "product_id", "date", "action", "priority", "description",
               "waste_reduction_units", "revenue_impact_usd", "waste_cost_saved_usd", "confidence",
               "markdown_pct"]


def recommendations_nested(recs: DataFrame) -> DataFrame:
    """One row per pair, actions as a priority-sorted array of structs (<=5)."""
    item = F.struct("priority", "action", "description", "waste_reduction_units",
                    F.col("revenue_impact_usd").cast("double").alias("revenue_impact_usd"),
                    F.col("waste_cost_saved_usd").cast("double").alias("waste_cost_saved_usd"),
                    F.col("confidence").cast("double").alias("confidence"))
    return (recs.groupBy(*KEYS, "date", "waste_risk_score")
            .agg(F.sort_array(F.collect_list(item)).alias("recommendations"))
            .select(*KEYS, "date", F.round(F.col("waste_risk_score").cast("double"), 3).alias("waste_risk_score"),
                    risk_tier(F.col("waste_risk_score")).alias("waste_risk_tier"), "recommendations"))


STATUSES = ("pending", "accepted", "rejected", "expired")


def recommendations_log(ctx) -> DataFrame:
    """The daily batch's ranked actions appended to the log with a status."""
    r = recommendations_daily(ctx)
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]),
                          ((F.col("store_id") + F.col("product_id") + F.col("priority")) % 4 + 1).cast("int"))
    accepted = status == "accepted"
    return r.select(
        ((F.col("store_id").cast("long") * 1000 + F.col("product_id")) * 100000
         + F.datediff("date", F.lit("2000-01-01").cast("date")) * 10 + F.col("priority")).alias("rec_id"),
        *KEYS, "date", F.col("action").alias("action_type"), "markdown_pct",
        F.col("waste_reduction_units").alias("expected_waste_reduction"),
        F.col("waste_cost_saved_usd").alias("expected_cost_saved_usd"),
        status.alias("status"),
        F.when(accepted, idiv(F.col("waste_reduction_units"), F.lit(2))).cast("int").alias("actual_waste_reduction"),
        F.when(accepted, F.floor(F.col("waste_cost_saved_usd") / 2)).cast(MONEY).alias("actual_cost_saved_usd"),
        (F.col("date").cast("timestamp_ntz") + F.make_interval(mins=F.col("priority"))).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("responded_at"))


# ---- waste-risk route (C1..C3) -----------------------------------------------------------

def waste_requests(ctx) -> DataFrame:
    """Requests derived from every inventory snapshot: stock on hand and expiry as posted."""
    return ctx.inventory_snapshots.select(
        *KEYS, "date", F.col("quantity_on_hand").alias("current_stock"),
        F.coalesce(F.col("days_until_expiry"), F.lit(7)).alias("days_until_expiry"))


def waste_request_features(ctx, requests: DataFrame | None = None) -> DataFrame:
    """Nearest feature row (A3) with expiry_norm and stock ratio overridden by the request."""
    req = requests if requests is not None else waste_requests(ctx)
    f = ctx.features
    near = nearest(req, f, KEYS, "date", "date",
                   ["shelf_life_days", "sales_rolling_7d_mean", "waste_rolling_7d_rate"])
    shelf = F.coalesce(F.nullif(F.col("shelf_life_days"), F.lit(0.0)), F.lit(7.0))
    avg7 = F.coalesce(F.nullif(F.col("sales_rolling_7d_mean"), F.lit(0.0)), F.lit(1.0))
    return near.select(
        *KEYS, "date", "current_stock", "days_until_expiry", "matched_date",
        (F.col("days_until_expiry") / F.greatest(shelf, F.lit(1.0))).alias("days_until_expiry_norm"),
        (F.col("current_stock") / F.greatest(avg7, F.lit(0.1))).alias("stock_to_sales_ratio"),
        "sales_rolling_7d_mean", "waste_rolling_7d_rate")


def waste_risk_report(ctx, requests: DataFrame | None = None) -> DataFrame:
    """Score (3 dp), tier, demand (1 dp), excess (C2), markdown %, explanation."""
    x = waste_request_features(ctx, requests)
    risk = waste_score()
    demand = F.col("sales_rolling_7d_mean")
    tier = risk_tier(risk)
    md = markdown_pct(risk, F.col("days_until_expiry"))
    expl = F.concat(
        F.initcap(tier), F.lit(" risk: "), F.col("days_until_expiry").cast("string"),
        F.lit(" days until expiry with "), F.col("current_stock").cast("string"), F.lit(" units on hand. "),
        F.lit("Historical velocity suggests ~"), demand.cast("int").cast("string"),
        F.lit(" units/day sellthrough."),
        F.when(md > 0, F.concat(F.lit(" Consider "), md.cast("string"), F.lit("% markdown to accelerate sales.")))
         .otherwise(F.lit("")))
    return x.where(F.col("matched_date").isNotNull()).select(
        *KEYS, "date", F.round(risk, 3).alias("waste_risk_score"), tier.alias("waste_risk_tier"),
        F.round(demand, 1).alias("predicted_demand"),
        route_excess(F.col("current_stock"), demand).alias("excess_stock"),
        md.cast("int").alias("recommended_markdown_pct"), expl.alias("explanation"))
