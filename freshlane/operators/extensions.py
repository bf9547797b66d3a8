"""Extensions X1..X10: items the reference documents but does not code.

All are expressions over the same (store, product) date-ordered window as
F3/F4 (no extra shuffle), fixed-calendar date arithmetic, or grouped
aggregates. Only past rows are used for anything a forecast would consume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshlane.functions.exprs import HOLIDAYS_MMDD, ratio6, safe_div
from freshlane.functions.quantiles import exact_percentiles
from freshlane.operators.features import KEYS, series_window


def ext_rolling(sales: DataFrame) -> DataFrame:
    """3-day lag, 14-row std, 7-row min / max (previous rows only)."""
    w = series_window()
    w7, w14 = w.rowsBetween(-7, -1), w.rowsBetween(-14, -1)
    return sales.select(*KEYS, "date",
                        F.lag("quantity_sold", 3).over(w).alias("sales_lag_3d"),
                        F.stddev_samp("quantity_sold").over(w14).alias("sales_rolling_14d_std"),
                        F.min("quantity_sold").over(w7).alias("sales_rolling_7d_min"),
                        F.max("quantity_sold").over(w7).alias("sales_rolling_7d_max"))


def ext_trend(sales: DataFrame) -> DataFrame:
    """Day-over-day change of the last two known days; last day vs the 7-row mean."""
    w = series_window()
    l1, l2 = F.lag("quantity_sold", 1).over(w), F.lag("quantity_sold", 2).over(w)
    s7 = F.sum("quantity_sold").over(w.rowsBetween(-7, -1))
    n7 = F.count("quantity_sold").over(w.rowsBetween(-7, -1))
    return sales.select(*KEYS, "date", (l1 - l2).alias("sales_diff_1d"),
                        # lag1 / (s7 / n7) as one integer quotient
                        F.coalesce(safe_div(l1 * n7, s7), F.lit(0.0)).alias("sales_ratio_7d"))


def _holiday_dates(year: Column) -> Column:
    return F.array(*[F.make_date(year, F.lit(m // 100), F.lit(m % 100)) for m in HOLIDAYS_MMDD])


def ext_holiday_distance(sales: DataFrame) -> DataFrame:
    """Days to the next / from the last fixed-calendar holiday (0 on a holiday)."""
    y = F.year("date")
    cands = F.concat(_holiday_dates(y - 1), _holiday_dates(y), _holiday_dates(y + 1))
    diffs = F.transform(cands, lambda h: F.datediff(h, F.col("date")))
    nxt = F.array_min(F.filter(diffs, lambda d: d >= 0))
    prv = F.array_max(F.filter(diffs, lambda d: d <= 0))
    return sales.select(*KEYS, "date", nxt.alias("days_to_next_holiday"), (-prv).alias("days_from_last_holiday"))


def ext_promo_day(sales: DataFrame) -> DataFrame:
    """Day N of the current run of promotion rows (0 when not on promotion)."""
    w = series_window()
    idx = F.row_number().over(w)
    last_off = F.last(F.when(~F.col("is_promotion"), F.col("_i")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0))
    d = sales.withColumn("_i", idx)
    return d.select(*KEYS, "date", F.when(F.col("is_promotion"), F.col("_i") - F.coalesce(last_off, F.lit(0)))
                    .otherwise(F.lit(0)).cast("int").alias("promo_day_number"))


def ext_supply(features: DataFrame, inventory: DataFrame) -> DataFrame:
    """Days of supply (on hand / 7-row mean) and distance to the reorder point."""
    inv = inventory.select(*KEYS, "date", "reorder_point")
    f = features.select(*KEYS, "date", "quantity_on_hand", "sales_rolling_7d_mean", "stock_to_sales_ratio")
    j = f.join(inv, [*KEYS, "date"], "left")
    return j.select(*KEYS, "date",
                    F.when(F.col("quantity_on_hand").isNotNull() & (F.col("sales_rolling_7d_mean") > 0),
                           F.col("stock_to_sales_ratio")).alias("days_of_supply"),
                    (F.col("quantity_on_hand") - F.col("reorder_point")).alias("reorder_point_distance"))


def ext_price_change(sales: DataFrame) -> DataFrame:
    """Change of the realised unit price (revenue / units) against the previous row,
    both as exactly rounded integer quotients (cents x units)."""
    w = series_window()
    d = (sales.withColumn("_c", (F.col("revenue") * 100).cast("decimal(18,0)"))
              .withColumn("_q", F.col("quantity_sold").cast("decimal(12,0)")))      # products stay below 10**31
    cp, qp = F.lag("_c", 1).over(w), F.lag("_q", 1).over(w)
    price = F.when(F.col("_q") > 0, ratio6(F.col("_c"), F.col("_q") * 100))
    # (c/q - cp/qp) / (cp/qp) = (c*qp - cp*q) / (cp*q)
    change = F.when((F.col("_q") > 0) & (qp > 0) & (cp > 0),
                    ratio6(F.col("_c") * qp - cp * F.col("_q"), cp * F.col("_q")))
    return d.select(*KEYS, "date", price.alias("unit_price_realised"), change.alias("price_change_pct"))


def ext_residual_interval(predictions: DataFrame, train_cut: Column) -> DataFrame:
    """Point -/+ |10th / 90th percentile of training residuals| per model version."""
    res = (predictions.where(F.col("actual_demand").isNotNull() & (F.col("date") < train_cut))
           .select("model_version", (F.col("actual_demand") - F.col("predicted_demand").cast("double")).alias("r")))
    q = exact_percentiles(res, ["model_version"], "r", [0.1, 0.9])
    qq = q.groupBy("model_version").agg(F.max(F.when(F.col("prob") == 0.1, F.col("value"))).alias("p10"),
                                        F.max(F.when(F.col("prob") == 0.9, F.col("value"))).alias("p90"))
    p = predictions.select(*KEYS, "date", "model_version", F.col("predicted_demand").cast("double").alias("pred"))
    j = p.join(F.broadcast(qq), "model_version")  # one row per model version
    return j.select(*KEYS, "date", "model_version", (F.col("pred") - F.abs("p10")).alias("lower_bound"),
                    (F.col("pred") + F.abs("p90")).alias("upper_bound"))


def ext_order_rules(inputs: DataFrame) -> DataFrame:
    """Reorder urgently when stock < 2 x demand; cut the next order 25 % when stock > 7 x demand."""
    s, d = F.col("current_stock"), F.col("predicted_demand")
    return inputs.select(*KEYS, "date", (s < 2 * d).alias("reorder_urgent"), (s > 7 * d).alias("reduce_order_25"))


def ext_kl(long_df: DataFrame, bins: int = 10, eps: float = 1e-4) -> DataFrame:
    """KL(recent || train) on the PSI bins per feature, alert when > 0.1."""
    stats = long_df.groupBy("feature").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"),
        F.count_if(F.col("sample") == "train").alias("n_e"), F.count_if(F.col("sample") == "recent").alias("n_a"))
    b = F.least(F.floor((F.col("v") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    binned = (long_df.join(F.broadcast(stats), "feature").where(F.col("hi") > F.col("lo"))
              .groupBy("feature", b.cast("int").alias("bin"))
              .agg(F.count_if(F.col("sample") == "train").alias("c_e"),
                   F.count_if(F.col("sample") == "recent").alias("c_a")))
    grid = stats.where(F.col("hi") > F.col("lo")).select(
        "feature", "n_e", "n_a", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    j = grid.join(binned, ["feature", "bin"], "left")
    e = F.coalesce(F.col("c_e"), F.lit(0)) / F.col("n_e") + eps
    a = F.coalesce(F.col("c_a"), F.lit(0)) / F.col("n_a") + eps
    kl = j.groupBy("feature").agg(F.sum(a * F.log(a / e)).alias("kl"))
    return stats.select("feature").join(kl, "feature", "left").select(
        "feature", F.round(F.coalesce("kl", F.lit(0.0)), 6).alias("kl"),
        (F.coalesce("kl", F.lit(0.0)) > 0.1).alias("alert"))


def ext_volume(sales: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Daily row count against the mean daily count; alert below 80 %."""
    d = sales.groupBy("date").agg(F.count(F.lit(1)).alias("rows"))
    exp = d.agg(F.avg("rows").alias("e")).select("e").scalar()
    return d.select("date", F.col("rows").cast("long"), F.round(exp, 6).alias("expected"),
                    (F.col("rows") < F.lit(ratio) * exp).alias("alert"))


def ext_interval_width(predictions: DataFrame) -> DataFrame:
    """Mean interval width per day and version; widening when above the previous 7 days' mean.

    Widths are summed in exact micro-units, so the result does not depend on
    summation order."""
    from freshlane.functions.exprs import idiv
    d = predictions.groupBy("model_version", "date").agg(
        F.sum(((F.col("confidence_upper") - F.col("confidence_lower")) * 1000000).cast("long")).alias("s"),
        F.count(F.lit(1)).alias("n"))
    d = d.withColumn("wu", idiv(F.lit(2) * F.col("s") + F.col("n"), F.lit(2) * F.col("n")))
    w = Window.partitionBy("model_version").orderBy("date").rowsBetween(-7, -1)
    ps, pn = F.sum("wu").over(w), F.count("wu").over(w)
    return d.select("model_version", "date", (F.col("wu") / F.lit(1e6)).alias("avg_width"),
                    ratio6(ps, pn * 1000000).alias("prev_7d_width"),
                    F.coalesce(F.col("wu") * pn > ps, F.lit(False)).alias("widening"))


def ext_baselines(df: DataFrame) -> DataFrame:
    """MAPE / MAE of yesterday, last-7 mean, 28-row mean and same-day-last-week (y > 0, non-NULL)."""
    y = F.col("quantity_sold").cast("double")
    cands = {"naive_yesterday": "sales_lag_1d", "weekly_average": "sales_rolling_7d_mean",
             "four_week_average": "sales_rolling_28d_mean", "same_day_last_week": "sales_lag_7d"}
    long = df.select(y.alias("y"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("baseline"), F.col(c).cast("double").alias("p")) for k, c in cands.items()]))
        .alias("x")).select("y", "x.*").where(F.col("p").isNotNull())
    return long.groupBy("baseline").agg(
        F.round(F.avg(F.when(F.col("y") > 0, F.abs(F.col("y") - F.col("p")) / F.col("y"))), 6).alias("mape"),
        F.round(F.avg(F.abs(F.col("y") - F.col("p"))), 6).alias("mae"),
        F.count(F.lit(1)).cast("long").alias("n"))
