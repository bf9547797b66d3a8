"""Deterministic scorers and the ``predictions`` fact.

The reference scores with boosted trees; to give every downstream operator
(rules, accuracy, feedback, drift) an exact oracle, the default scorers are
documented baselines over the filled features:

* demand ``v1`` = trailing 7-row mean; ``v2`` = 7-row lag (even product ids);
* interval = mean -/+ z * std, clipped at 0;
* waste risk = min(1, 10 x trailing 7-row waste rate).

The Spark ML models (operators/models.py) emit the same columns.
Numbers are stored as DECIMAL(16,6) so later sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.config import Config
from freshlane.functions.exprs import risk_tier, to_dec

DEC = "decimal(16,6)"


def demand_point(f: DataFrame) -> Column:
    return F.col("sales_rolling_7d_mean")


def demand_bounds(z: float) -> tuple[Column, Column]:
    m, s = F.col("sales_rolling_7d_mean"), F.col("sales_rolling_7d_std")
    return F.greatest(F.lit(0.0), m - F.lit(z) * s), F.greatest(F.lit(0.0), m + F.lit(z) * s)


def waste_score() -> Column:
    """Ten times the trailing waste rate, at most 1: the fixture wastes about 6 %, so all tiers and actions occur."""
    return F.least(F.lit(1.0), F.lit(10.0) * F.col("waste_rolling_7d_rate"))


def score_frame(features: DataFrame, config: Config | None = None) -> DataFrame:
    """M2/M3/M6/M7 with the deterministic scorers: one row per feature row (v1)."""
    config = config or Config()
    lo, hi = demand_bounds(config.interval_z)
    return features.select(
        "store_id", "product_id", "date",
        to_dec(demand_point(features), 16, 6).alias("predicted_demand"),
        to_dec(lo, 16, 6).alias("confidence_lower"), to_dec(hi, 16, 6).alias("confidence_upper"),
        to_dec(waste_score(), 16, 6).alias("waste_risk_score"),
        risk_tier(waste_score()).alias("waste_risk_tier"))


def forecast_error(pred_dec: Column, actual: Column) -> Column:
    """(pred - actual) / max(actual, 1) rounded half away from zero to 6 dp, exactly:
    in integer micro-units, so no binary or double-rounding ties."""
    from freshlane.functions.exprs import idiv
    n = (pred_dec * 1000000).cast("long") - actual.cast("long") * 1000000
    d = F.greatest(actual.cast("long"), F.lit(1))
    q = F.signum(n).cast("long") * idiv(F.lit(2) * F.abs(n) + d, F.lit(2) * d)
    return (q.cast("decimal(20,0)") / 1000000).cast(DEC)


def predictions_table(features: DataFrame, sales: DataFrame, config: Config | None = None) -> DataFrame:
    """``predictions`` (store, product, date, version): v1 for every row, v2 for even ids.

    actual_demand is known up to 3 days before the last date; forecast_error =
    (pred - actual) / max(actual, 1).
    """
    config = config or Config()
    lo, hi = demand_bounds(config.interval_z)
    last = features.agg(F.max("date").alias("d")).select("d").scalar()
    base = features.select(
        "store_id", "product_id", "date", "quantity_sold",
        lo.alias("lo"), hi.alias("hi"), waste_score().alias("risk"),
        F.col("sales_rolling_7d_mean").alias("p1"), F.col("sales_lag_7d").alias("p2"))
    v1 = base.select("*", F.lit("v1").alias("model_version"), F.col("p1").alias("p"), F.lit(6).alias("h"))
    v2 = (base.where(F.col("product_id") % 2 == 0)
          .select("*", F.lit("v2").alias("model_version"), F.col("p2").alias("p"), F.lit(7).alias("h")))
    u = v1.unionByName(v2)
    actual = F.when(F.col("date") <= F.date_sub(last, 3), F.col("quantity_sold"))
    pred = to_dec(F.col("p"), 16, 6)
    err = forecast_error(pred, F.col("actual_demand"))
    return (u.withColumn("actual_demand", actual.cast("int"))
            .select("store_id", "product_id", "date", "model_version",
                    pred.alias("predicted_demand"),
                    to_dec(F.col("lo"), 16, 6).alias("confidence_lower"),
                    to_dec(F.col("hi"), 16, 6).alias("confidence_upper"),
                    to_dec(F.col("risk"), 16, 6).alias("waste_risk_score"),
                    risk_tier(F.col("risk")).alias("waste_risk_tier"),
                    "actual_demand",
                    F.when(F.col("actual_demand").isNotNull(), err).cast(DEC).alias("forecast_error"),
                    (F.col("date").cast("timestamp_ntz") + F.make_interval(hours=F.col("h")))
                    .alias("created_at")))
