"""Posted requests: lists of bounded size (Q8), requests without features (A8), waste risk by fitted models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS
from freshlane.functions.exprs import markdown_pct, risk_tier
from freshlane.operators import models as M
from freshlane.operators.asof import nearest
from freshlane.operators.quality import request_validity
from freshlane.operators.rules import route_excess

#: Requests in one posted list (fixed values).
MIN_LIST, MAX_LIST = 1, 500


def list_size_reason(size: Column) -> Column:
    """Why a list of ``size`` requests is refused; NULL if it is not."""
    return F.when(size < MIN_LIST, f"fewer than {MIN_LIST}").when(size > MAX_LIST, f"more than {MAX_LIST}")


def list_validity(lists: DataFrame, requests: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Q8: (accepted, refused) requests; a list out of bounds is refused whole, else its first bad request refuses it.

    ``lists`` has a row for each posted list, empty ones included; ``requests`` carry the list's ``keys``. Accepted has
    one row per request. Refused has one row per list: size, reason (the size's, else that of the lowest reason in order
    of the alphabet) and n_bad (requests that break a rule). Sizes are counted before the shuffle, so a hot list is no
    hot task but in the join back, which AQE splits.
    """
    keys = list(keys)
    checked = request_validity(requests)
    sizes = checked.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.count("reason").alias("n_bad"), F.min("reason").alias("bad"))
    judged = lists.select(*keys).distinct().join(sizes, keys, "left").select(
        *keys, F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.coalesce("n_bad", F.lit(0)).cast("long").alias("n_bad"), "bad")
    judged = judged.withColumn("reason", F.coalesce(list_size_reason(F.col("size")), F.col("bad")))
    accepted = checked.drop("status", "reason").join(judged.where("reason IS NULL").select(*keys), keys, "left_semi")
    return accepted, judged.where("reason IS NOT NULL").select(*keys, "size", "n_bad", "reason")


def served_or_missing(requests: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every request with ``found``, whether its key has a fact row at all; one pass over the distinct keys."""
    known = facts.select(*keys).distinct().withColumn("_known", F.lit(True))
    return requests.join(known, list(keys), "left").withColumn("found", F.col("_known").isNotNull()).drop("_known")


def posted_vectors(requests: DataFrame, features: DataFrame) -> DataFrame:
    """The 35 features of the nearest day of every request (NULL: 0), with the two that the posted stock and expiry
    override; requests without features are left out (A8)."""
    near = nearest(requests, features, ["store_id", "product_id"], "date", "date", FEATURE_COLUMNS)

    def or_else(column: str, value: float) -> Column:
        return F.coalesce(F.nullif(F.col(column).cast("double"), F.lit(0.0)), F.lit(value))

    posted = {"days_until_expiry_norm": F.col("days_until_expiry") / F.greatest(or_else("shelf_life_days", 7.0), F.lit(1.0)),
              "stock_to_sales_ratio": F.col("current_stock") / F.greatest(or_else("sales_rolling_7d_mean", 1.0), F.lit(0.1))}
    return near.where(F.col("matched_date").isNotNull()).select(
        *M.KEYS3, "current_stock", "days_until_expiry", "matched_date",
        *[posted.get(c, F.coalesce(F.col(c).cast("double"), F.lit(0.0))).alias(c) for c in FEATURE_COLUMNS])


def fitted_waste_report(requests: DataFrame, features: DataFrame, demand, waste) -> DataFrame:
    """C3 by fitted models: both score the vector with the posted stock and expiry in place, in one pass.

    Score 3 dp, tier, demand 1 dp, excess over whole units of demand, markdown %. Repeated requests give repeated rows.
    """
    rows = posted_vectors(requests, features).withColumn("label", F.lit(0.0)).withColumn("w", F.lit(1.0))
    scored = demand.transform(rows).drop("features_vec")
    point = F.greatest(F.lit(0.0), F.lit(0.6) * F.col("p_gbt") + F.lit(0.4) * F.col("p_rf"))
    scored = waste.transform(scored.withColumn("_demand", point).drop("p_gbt", "p_rf", "p_tree", "leaf"))
    risk, demanded = M.vector_to_array("probability")[1], F.col("_demand")
    return scored.select(
        *M.KEYS3, "current_stock", "days_until_expiry", F.round(risk, 3).alias("waste_risk_score"),
        risk_tier(risk).alias("waste_risk_tier"), F.round(demanded, 1).alias("predicted_demand"),
        route_excess(F.col("current_stock"), demanded).alias("excess_stock"),
        markdown_pct(risk, F.col("days_until_expiry")).cast("int").alias("recommended_markdown_pct"))
