"""Labels, time splits and class balance (L1..L7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS, Config
from freshlane.operators.features import KEYS, series_window


def waste_labels(sales: DataFrame) -> DataFrame:
    """L1 as coded: any waste in {yesterday, today, tomorrow} of the series.

    The reference's shift(-1) then trailing 3-row sum: lead first, then a
    window over the led series (two window passes on the same spec).
    """
    return add_waste_label(sales).select(*KEYS, "date", "waste_label")


def add_waste_label(df: DataFrame) -> DataFrame:
    """``df`` (with units_wasted, one row per key and date) with L1's label in place: no join."""
    w = series_window()
    led = df.withColumn("_next", F.lead("units_wasted", 1).over(w))
    s = F.sum("_next").over(w.rowsBetween(-2, 0))
    return led.withColumn("waste_label", (F.coalesce(s, F.lit(0)) > 0).cast("int")).drop("_next")


def waste_labels_forward(sales: DataFrame) -> DataFrame:
    """L2, the documented intent: any waste in the next 3 rows."""
    s = F.sum("units_wasted").over(series_window().rowsBetween(1, 3))
    return sales.select(*KEYS, "date", (F.coalesce(s, F.lit(0)) > 0).cast("int").alias("waste_label"))


def split_cutoffs(df: DataFrame, config: Config | None = None) -> DataFrame:
    """L3 cut-offs: sorted distinct dates, c1 = dates[int(n*0.65)], c2 = dates[int(n*0.80)].

    Works on the distinct dates only: one row per calendar day, bounded by the
    calendar (36.5k rows per century) whatever the data size, so the ranking
    window over them is a small single-task step after a distributed distinct.
    """
    config = config or Config()
    d = df.select("date").distinct()
    r = d.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"),
                 F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    i1 = F.floor(F.col("n") * F.lit(config.train_ratio))
    i2 = F.floor(F.col("n") * F.lit(config.val_ratio))
    return r.agg(F.max(F.when(F.col("i") == i1, F.col("date"))).alias("c1"),
                 F.max(F.when(F.col("i") == i2, F.col("date"))).alias("c2"),
                 F.max("n").cast("long").alias("n_dates"))


def time_split(df: DataFrame, config: Config | None = None) -> DataFrame:
    """L3: train < c1 <= val < c2 <= test."""
    return add_split(df, df, config).select(*KEYS, "date", "split")


def add_split(df: DataFrame, dates: DataFrame, config: Config | None = None) -> DataFrame:
    """``df`` with L3's split by the dates of ``dates``, in place."""
    cut = split_cutoffs(dates, config)
    c1, c2 = cut.select("c1").scalar(), cut.select("c2").scalar()
    return df.withColumn("split", F.when(F.col("date") < c1, "train").when(F.col("date") < c2, "val").otherwise("test"))


def add_retrain_split(df: DataFrame, config: Config | None = None) -> DataFrame:
    """``df`` with L4's split: val from max-45 days, test from max-15 days, in place."""
    config = config or Config()
    last = df.agg(F.max("date").alias("d")).select("d").scalar()
    v, t = F.date_sub(last, config.retrain_val_days), F.date_sub(last, config.retrain_test_days)
    return df.withColumn("split", F.when(F.col("date") < v, "train").when(F.col("date") < t, "val").otherwise("test"))


def retrain_split(df: DataFrame, config: Config | None = None) -> DataFrame:
    """L4."""
    return add_retrain_split(df, config).select(*KEYS, "date", "split")


def class_balance(rows: DataFrame) -> DataFrame:
    """L5 per split of ``rows`` (split, waste_label): positives, negatives, rate, scale_pos_weight = neg / max(pos, 1)."""
    g = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("waste_label").alias("pos"))
    return g.select("split", F.col("n").cast("long"), F.col("pos").cast("long"),
                    (F.col("n") - F.col("pos")).cast("long").alias("neg"),
                    F.round(F.col("pos") / F.col("n"), 6).alias("pos_rate"),
                    F.round((F.col("n") - F.col("pos")) / F.greatest(F.col("pos"), F.lit(1)), 6)
                    .alias("scale_pos_weight"))


def serving_vectors(features: DataFrame) -> DataFrame:
    """The 35 inputs with NULL -> 0.0 (what a serving request sends to the model)."""
    return features.select(*KEYS, "date", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                                            for c in FEATURE_COLUMNS])

