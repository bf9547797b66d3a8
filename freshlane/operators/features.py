"""Feature pipeline F0..F8: the 35 model features per (store, product, day).

Plan shape: one Exchange on (store_id, product_id), one sort on date, and all
lag / trailing-window columns share the same ``Window`` spec, so Catalyst
computes them in a single Window operator. Products and stores are dimension
tables bounded by construction and are broadcast. Lags and windows are
row-based (previous rows of the series), as the reference computes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS, Config
from freshlane.functions import exprs as X
from freshlane.functions.quantiles import exact_median_row

KEYS = ["store_id", "product_id"]


def series_window():
    return Window.partitionBy(*KEYS).orderBy("date")


def base_join(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """sales LEFT JOIN inventory (on-hand, expiry) on (store, product, date).

    Both tables hold at most one row per (store, product, date), so the left join
    is computed inside the series window: union the two, order each series by
    (date, inventory first) and take the previous row when it is the same day's
    snapshot. This shares the single (store, product) exchange and date sort with
    every lag / trailing window of F3..F7 instead of shuffling both sides on
    (store, product, date) and then again on (store, product).
    """
    return base_of(series_rows(sales, inventory))


def series_rows(sales: DataFrame, inventory: DataFrame) -> DataFrame:
    """Both facts in one frame: a sale's row and a snapshot's row of every series and day."""
    inv = inventory.select(*KEYS, "date", F.struct("quantity_on_hand", "days_until_expiry").alias("_inv"),
                           F.lit(0).alias("_side"))
    return sales.withColumn("_side", F.lit(1)).unionByName(inv, allowMissingColumns=True)


def base_of(series: DataFrame) -> DataFrame:
    """F1's rows of ``series_rows``."""
    w = Window.partitionBy(*KEYS).orderBy("date", "_side")
    prev_date = F.lag("date", 1).over(w)
    prev_inv = F.lag("_inv", 1).over(w)
    same_day = (prev_date == F.col("date"))
    out = (series.withColumn("_pinv", F.when(same_day, prev_inv))
           .where(F.col("_side") == 1)
           .withColumn("quantity_on_hand", F.col("_pinv.quantity_on_hand"))
           .withColumn("days_until_expiry", F.col("_pinv.days_until_expiry")))
    return out.drop("_side", "_inv", "_pinv")


def add_temporal(df: DataFrame) -> DataFrame:
    """7 calendar columns (Monday = 0, ISO week)."""
    dom = F.dayofmonth("date")
    dow = F.weekday("date")
    return df.withColumns({
        "day_of_week": dow.cast("int"),
        "day_of_month": dom.cast("int"),
        "week_of_year": F.weekofyear("date").cast("int"),
        "month": F.month("date").cast("int"),
        "is_weekend": (dow >= 5).cast("int"),
        "is_month_start": (dom <= 3).cast("int"),
        "is_month_end": (dom >= 28).cast("int"),
    })


def add_lags(df: DataFrame) -> DataFrame:
    """row-based lags over the series."""
    w = series_window()
    return df.withColumns({
        "sales_lag_1d": F.lag("quantity_sold", 1).over(w),
        "sales_lag_7d": F.lag("quantity_sold", 7).over(w),
        "sales_lag_14d": F.lag("quantity_sold", 14).over(w),
        "sales_lag_28d": F.lag("quantity_sold", 28).over(w),
        "waste_lag_1d": F.lag("units_wasted", 1).over(w),
        "waste_lag_7d": F.lag("units_wasted", 7).over(w),
        "inventory_lag_1d": F.lag("quantity_on_hand", 1).over(w),
    })


def add_rolling(df: DataFrame) -> DataFrame:
    """trailing aggregates over the previous k rows (current row excluded)."""
    w = series_window()
    w7, w14, w28 = w.rowsBetween(-7, -1), w.rowsBetween(-14, -1), w.rowsBetween(-28, -1)
    s7 = F.sum("quantity_sold").over(w7)
    wsum7 = F.sum("units_wasted").over(w7)
    return df.withColumns({
        "sales_rolling_7d_mean": F.avg("quantity_sold").over(w7),
        "sales_rolling_7d_std": F.stddev_samp("quantity_sold").over(w7),
        "sales_rolling_14d_mean": F.avg("quantity_sold").over(w14),
        "sales_rolling_28d_mean": F.avg("quantity_sold").over(w28),
        "waste_rolling_7d_sum": wsum7.cast("double"),
        "waste_rolling_7d_rate": F.coalesce(X.safe_div(wsum7, s7), F.lit(0.0)),
        "revenue_rolling_7d": F.sum("revenue").over(w7).cast("double"),
        "sales_rolling_7d_median": F.percentile("quantity_sold", 0.5).over(w7),
        "_s7": s7, "_n7": F.count("quantity_sold").over(w7),
    })


def add_product_features(df: DataFrame, products: DataFrame) -> DataFrame:
    """prices, shelf life, margin, category code (products: <=150 rows, broadcast)."""
    p = products.select(
        "product_id", F.col("unit_price").cast("double").alias("unit_price"),
        F.col("cost_price").cast("double").alias("cost_price"), "shelf_life_days",
        F.coalesce(X.safe_div((F.col("unit_price") - F.col("cost_price")).cast("double"),
                              F.col("unit_price").cast("double")), F.lit(0.0)).alias("margin_pct"),
        (F.col("category_id") - 1).cast("int").alias("category_encoded"))
    return df.join(F.broadcast(p), "product_id", "left")


def add_contextual(df: DataFrame, stores: DataFrame | None) -> DataFrame:
    """flag / numeric casts and the store type code (1 when no stores table)."""
    df = df.withColumns({
        "is_holiday": F.col("is_holiday").cast("int"),
        "is_promotion": F.col("is_promotion").cast("int"),
        "promotion_discount": F.col("promotion_discount").cast("double"),
        "temperature_avg": F.col("temperature_avg").cast("double"),
    })
    if stores is None:
        return df.withColumn("store_type_encoded", F.lit(1))
    st = stores.select("store_id", X.case_map("type", X.STORE_TYPE_CODE).cast("int").alias("store_type_encoded"))
    return df.join(F.broadcast(st), "store_id", "left")


def add_derived(df: DataFrame) -> DataFrame:
    """promo recency (0 on a promo day, 999 before the first), stock cover, expiry norm."""
    w_upto = series_window().rowsBetween(Window.unboundedPreceding, 0)
    last_promo = F.last(F.when(F.col("is_promotion") == 1, F.col("date")), ignorenulls=True).over(w_upto)
    shelf = F.col("shelf_life_days")
    return df.withColumns({
        "days_since_last_promo": F.coalesce(F.datediff("date", last_promo), F.lit(999)).cast("int"),
        # on_hand / mean7 as one integer quotient (on_hand * n7 / sum7): correctly rounded
        "stock_to_sales_ratio": F.coalesce(X.safe_div(F.col("quantity_on_hand") * F.col("_n7"), F.col("_s7")),
                                           F.lit(0.0)),
        "days_until_expiry_norm": F.col("days_until_expiry").cast("double")
        / F.when(shelf == 0, F.lit(1)).otherwise(shelf).cast("double"),
    })


def feature_medians(df: DataFrame, config: Config | None = None, every: bool = False) -> dict[str, float | None]:
    """Exact global median of each of the 35 features that has NULLs in ``df``, or of all with ``every``
    (distributed order statistic); None for the others.

    The result is 35 numbers, bounded by the feature count, so it is fetched
    once and inlined as literals: the fill then costs one projection.
    """
    config = config or Config()
    # a column without NULLs needs no median: count first, then rank only the others
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in FEATURE_COLUMNS]).first()
    cols = [c for c in FEATURE_COLUMNS if counts[c] and (every or counts[c] < counts["_rows"])]
    found: dict[str, float | None] = dict.fromkeys(FEATURE_COLUMNS)
    if cols:
        if config.exact_median:
            med = exact_median_row(df, cols)
        else:
            med = df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, config.median_accuracy).alias(c)
                           for c in cols])
        found.update(med.first().asDict())
    return found


def fill_missing(df: DataFrame, config: Config | None = None, fit_on: DataFrame | None = None,
                 medians: dict | None = None) -> DataFrame:
    """F8: NULL -> exact global median of the column (0 when the column is all NULL).

    ``fit_on`` computes the medians on another frame (e.g. the train split).
    """
    med = medians if medians is not None else (
        feature_medians(df, config) if fit_on is None else feature_medians(fit_on, config, every=True))
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"),
                      F.lit(float(med[c]) if med.get(c) is not None else 0.0))
        for c in FEATURE_COLUMNS
    })


def build_features(sales: DataFrame, products: DataFrame, inventory: DataFrame,
                   stores: DataFrame | None = None, fill: bool = True,
                   config: Config | None = None) -> DataFrame:
    """the 8 stages in order; returns keys, raw columns and the 35 features."""
    df = features_of(base_join(sales, inventory), products, stores)
    if fill:
        df = fill_missing(df, config)
    return df


def features_of(base: DataFrame, products: DataFrame, stores: DataFrame | None = None) -> DataFrame:
    """F2..F7 of F1's rows."""
    return (base.transform(add_temporal)
            .transform(add_lags)
            .transform(add_rolling)
            .transform(lambda d: add_product_features(d, products))
            .transform(lambda d: add_contextual(d, stores))
            .transform(add_derived)
            .drop("_s7", "_n7"))
