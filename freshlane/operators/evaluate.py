"""Evaluation aggregates (E1..E8), all one-pass grouped aggregates.

Threshold-free metrics (AUC, average precision) need cumulative counts over
the score order; they run on distinct scores with the bucketed prefix sums of
``functions.quantiles`` instead of a global window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshlane.functions.quantiles import prefix_sums


def forecast_metrics(df: DataFrame, group: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """E1..E3: n, rmse, mae, mape (y > 0 only, 0 if none), wape (0 if sum y = 0), r2."""
    yv, pv = F.col(y).cast("double"), F.col(p).cast("double")
    err = pv - yv
    g = df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg(F.when(yv > 0, F.abs(err) / yv)).alias("mape"),
        F.sum(F.abs(err)).alias("abs_err"), F.sum(yv).alias("sum_y"),
        F.sum(err * err).alias("sse"), F.var_pop(yv).alias("var_y"))
    return g.select(
        *group, F.col("n").cast("long"),
        F.round(F.sqrt("mse"), 6).alias("rmse"), F.round("mae", 6).alias("mae"),
        F.round(F.coalesce(F.col("mape"), F.lit(0.0)), 6).alias("mape"),
        F.round(F.when(F.col("sum_y") != 0, F.col("abs_err") / F.col("sum_y")).otherwise(0.0), 6).alias("wape"),
        F.round(F.lit(1.0) - F.col("sse") / (F.col("var_y") * F.col("n")), 6).alias("r2"))


def business_cost(df: DataFrame, group: list[str]) -> DataFrame:
    """Over-forecast x cost price + under-forecast x margin (exact decimals).
    ``df`` has y (int), p (decimal), unit_price, cost_price."""
    e = F.col("p") - F.col("y")
    over = F.when(e > 0, e * F.col("cost_price")).otherwise(0)
    under = F.when(e < 0, -e * (F.col("unit_price") - F.col("cost_price"))).otherwise(0)
    return (df.where(F.col("y").isNotNull()).groupBy(*group)
            .agg(F.sum(over).alias("over_cost"), F.sum(under).alias("under_cost"))
            .select(*group, F.round(F.col("over_cost").cast("double"), 6).alias("overforecast_cost"),
                    F.round(F.col("under_cost").cast("double"), 6).alias("underforecast_cost"),
                    F.round((F.col("over_cost") + F.col("under_cost")).cast("double"), 6).alias("business_cost")))


def classifier_metrics(df: DataFrame, group: list[str], threshold: float = 0.5) -> DataFrame:
    """E5: confusion counts, precision, recall, f1 at ``threshold`` (zero_division = 0)."""
    pred = (F.col("score") >= threshold).cast("int")
    y = F.col("label")
    g = df.groupBy(*group).agg(
        F.sum(((pred == 1) & (y == 1)).cast("int")).alias("tp"),
        F.sum(((pred == 1) & (y == 0)).cast("int")).alias("fp"),
        F.sum(((pred == 0) & (y == 1)).cast("int")).alias("fn"),
        F.sum(((pred == 0) & (y == 0)).cast("int")).alias("tn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    f1 = F.when(2 * F.col("tp") + F.col("fp") + F.col("fn") > 0,
                2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return g.select(*group, *[F.col(c).cast("long") for c in ("tp", "fp", "fn", "tn")],
                    F.round(prec, 6).alias("precision"), F.round(rec, 6).alias("recall"),
                    F.round(f1, 6).alias("f1"))


def _score_counts(df: DataFrame, group: list[str]) -> DataFrame:
    return df.groupBy(*group, "score").agg(F.sum(F.col("label")).cast("long").alias("pos"),
                                           F.sum(1 - F.col("label")).cast("long").alias("neg"))


def auc_roc(df: DataFrame, group: list[str]) -> DataFrame:
    """Exact ROC AUC with ties counted half; 0 when only one class."""
    c = prefix_sums(_score_counts(df, group), group, "score", ["neg", "pos"])
    g = c.groupBy(*group).agg(
        F.sum(F.col("pos") * F.col("prev_neg") + F.col("pos") * F.col("neg") * F.lit(0.5)).alias("num"),
        F.max("all_pos").alias("P"), F.max("all_neg").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / (F.col("P") * F.col("N"))).otherwise(0.0)
    return g.select(*group, F.round(auc, 6).alias("auc_roc"))


def average_precision(df: DataFrame, group: list[str]) -> DataFrame:
    """Step-wise average precision sum (R_n - R_{n-1}) P_n over descending thresholds."""
    c = prefix_sums(_score_counts(df, group), group, "score", ["neg", "pos"], descending=True)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    g = c.groupBy(*group).agg(F.sum(F.col("pos") * prec).alias("num"),
                              F.max("all_pos").alias("P"), F.max("all_neg").alias("N"))
    ap = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("num") / F.col("P")).otherwise(0.0)
    return g.select(*group, F.round(ap, 6).alias("average_precision"))


def baseline_mape(df: DataFrame, group: list[str]) -> DataFrame:
    """MAPE of lag-1, lag-7 and their mean (null-skipping), y > 0 rows; NULL = key absent."""
    y = F.col("y").cast("double")

    def m(pred):
        return F.avg(F.when((y > 0) & pred.isNotNull(), F.abs(y - pred) / y))
    l1, l7 = F.col("lag1").cast("double"), F.col("lag7").cast("double")
    both = F.when(l1.isNull(), l7).when(l7.isNull(), l1).otherwise((l1 + l7) / 2)
    g = df.groupBy(*group).agg(m(l1).alias("a"), m(l7).alias("b"), m(both).alias("c"),
                               F.count_if((y > 0) & l7.isNotNull()).alias("n7"))
    return g.select(*group, F.round("a", 6).alias("naive_lag1_mape"), F.round("b", 6).alias("naive_lag7_mape"),
                    F.round(F.when(F.col("n7") > 0, F.col("c")), 6).alias("moving_avg_mape"))
