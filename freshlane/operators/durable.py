"""Durable state on month tables: S6, S7, I4 and M8 as merges of the touched months, F0 / S3 as appends of days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshlane.config import Config
from freshlane.operators import features as FE
from freshlane.operators import state as ST
from freshlane.operators.asof import latest_by
from freshlane.operators.scoring import score_frame
from freshlane.sources.monthly import MonthTable

KEYS, KEYS3 = ["store_id", "product_id"], ["store_id", "product_id", "date"]


# ---- predictions
def predictions_store(spark: SparkSession, root: str, predictions: DataFrame) -> MonthTable:
    """The predictions fact as a month table; ``predictions`` fill it if it is new."""
    table = MonthTable(spark, root, predictions.schema)
    if table.state()["n"] == 0:
        table.commit(predictions, table.state())
    return table


def upsert(table: MonthTable, new: DataFrame, now: Column | None = None) -> bool:
    """S6 on the table; a repeated upsert of the same rows changes nothing."""
    return table.merge(new, lambda old, rows: ST.upsert_predictions(old, rows, now))


def record(table: MonthTable, actuals: DataFrame) -> bool:
    """S7 on the table: actuals of predictions that have none."""
    return table.merge(actuals, ST.record_actuals)


def daily_forecast_rows(features: DataFrame, target: Column, config: Config | None = None) -> DataFrame:
    """M8's rows: every pair's newest feature row up to the target date, scored for that date as v1, 2 places for
    demand and bounds, 4 for the risk (the tier is that of the unrounded risk)."""
    latest = latest_by(features.where(F.col("date") <= target), KEYS, "date")
    scored = score_frame(latest, config)
    two = [F.round(c, 2).cast("decimal(16,6)").alias(c) for c in ("predicted_demand", "confidence_lower", "confidence_upper")]
    return scored.select(*KEYS, target.alias("date"), F.lit("v1").alias("model_version"), *two,
                         F.round("waste_risk_score", 4).cast("decimal(16,6)").alias("waste_risk_score"), "waste_risk_tier")


def run_daily_forecast(table: MonthTable, features: DataFrame, target: Column, now: Column | None = None,
                       config: Config | None = None) -> bool:
    """M8: score and upsert under v1. New pairs of the day are inserted, known ones keep created_at and actuals."""
    return upsert(table, daily_forecast_rows(features, target, config), now)


def add_actuals(table: MonthTable, sums: DataFrame, source: str, number: int) -> bool:
    """Add a batch's sums (store_id, product_id, date, q) to the running totals, once for each batch number."""
    def add(old, new):
        return old.unionByName(new).groupBy(*KEYS3).agg(F.sum("q").alias("q"))
    return table.merge(sums.select(*KEYS3, "q"), add, source, number)


def apply_actuals(table: MonthTable, totals: DataFrame, source: str, number: int) -> bool:
    """I4 on the table with the running totals of the keys of a batch, once for each batch number."""
    items = totals.select(*KEYS3, F.col("q").alias("actual_sold"))
    return table.merge(items, ST.update_with_actuals, source, number)


# ---- features
#: Rows of a series that lags and trailing windows look back to.
LOOK_BACK = 28
RAW = ["quantity_sold", "revenue", "units_wasted", "units_donated", "temperature_avg", "is_holiday", "is_promotion",
       "promotion_discount", "quantity_on_hand", "days_until_expiry"]


def extended(base: DataFrame, promos: DataFrame | None, products: DataFrame, stores: DataFrame | None) -> DataFrame:
    """F2..F7 of ``base`` (F1 rows); ``promos`` has the last promotion day of a series before its first row."""
    f = FE.features_of(base, products, stores)
    if promos is None:
        return f
    f = f.join(promos.select(*KEYS, F.col("last_promo").alias("_before")), KEYS, "left")
    since = F.when(F.col("days_since_last_promo") == 999, F.coalesce(F.datediff("date", "_before"), F.lit(999)))
    return f.withColumn("days_since_last_promo", F.coalesce(since, "days_since_last_promo").cast("int")).drop("_before")


def tail_of(base: DataFrame, promos: DataFrame | None = None) -> DataFrame:
    """What the next append needs of each series: its last LOOK_BACK rows and, on every row, its last promotion day."""
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("date"))).alias("_place")
    last = base.groupBy(*KEYS).agg(F.max(F.when(F.col("is_promotion"), F.col("date"))).alias("last_promo"))
    if promos is not None:
        last = (last.join(promos.select(*KEYS, F.col("last_promo").alias("_before")), KEYS, "full_outer")
                .select(*KEYS, F.coalesce("last_promo", "_before").alias("last_promo")))
    kept = base.select(*KEYS3, *RAW, place).where(F.col("_place") <= LOOK_BACK).drop("_place")
    return kept.join(last, KEYS)


class FeatureTable:
    """F1..F7 (NULLs unfilled, as F8's medians are global) that grow by days: an append reads only the new rows and the
    stored tail of every series, and both are committed together with the day that the table reaches."""

    def __init__(self, spark: SparkSession, root: str, products: DataFrame, stores: DataFrame | None):
        self.spark, self.products, self.stores = spark, products, stores
        self.root, self.table, self.tail_schema = root, None, None

    def _open(self, base: DataFrame) -> MonthTable:
        if self.table is None:
            self.table = MonthTable(self.spark, self.root, extended(base, None, self.products, self.stores).schema)
            self.tail_schema = tail_of(base).schema
        return self.table

    def append(self, sales: DataFrame, inventory: DataFrame, through: int) -> bool:
        """Add the rows of ``sales`` (all later than those held); ``through`` is their last day as a number, and an
        append up to a day that the table has reached changes nothing."""
        base = FE.base_join(sales, inventory)
        table = self._open(base)
        state = table.state()
        if through <= state["done"].get("days", -1):
            return False
        if state["n"] == 0:
            table.commit(extended(base, None, self.products, self.stores), state, side={"tail": tail_of(base)},
                         source="days", number=through)
            return True
        tail = table.read_side("tail", self.tail_schema, state)
        promos = tail.groupBy(*KEYS).agg(F.first("last_promo").alias("last_promo"))
        # the tail of series without new rows stays as it is
        whole = tail.select(*KEYS3, *RAW, F.lit(False).alias("_new")).unionByName(base.select(*KEYS3, *RAW, F.lit(True).alias("_new")))
        fresh = extended(whole, promos, self.products, self.stores).where("_new")
        table.append(fresh.select(*table.schema.names), state, side={"tail": tail_of(whole.drop("_new"), promos)}, source="days", number=through)
        return True

    def read(self) -> DataFrame:
        return self.table.read()

