"""Retail tables derived from the driver tables (rules in FIXTURES.md §3).

``Retail(spark, sf_dir)`` exposes ``stores``, ``categories``, ``products``,
``daily_sales``, ``inventory_snapshots``, ``alerts`` and ``site_visits`` as lazy
DataFrames. Nothing is collected: every table is a plan over the Parquet scans.

Scale notes
-----------
* ``daily_sales`` is the only heavy derivation: lineitem joined to its part and
  supplier keys, then grouped by (store, product, day). Partial aggregation runs
  map-side, so the shuffle carries at most one row per group and task; the
  output is bounded by stores x products x 240 days no matter how big lineitem is.
* part and supplier grow with the data, so they are *not* force-broadcast; Spark's
  size statistics (and AQE at runtime) pick broadcast only while they are small,
  and sort-merge beyond. region / nation are fixed-size dimensions.
* Skewed part or supplier keys are handled by AQE skew-join splitting.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshlane.functions import exprs as X
from freshlane.sources.driver import input_state, read_table


def _part_keys(part: DataFrame) -> DataFrame:
    """p_partkey -> (category_id, brand number, product_id)."""
    cat = X.category_index("p_type")
    b = F.substring("p_brand", 7, 10).cast("int")
    return part.select(
        "p_partkey", "p_type", "p_brand", "p_retailprice",
        cat.alias("category_id"), b.alias("brand_no"),
        ((cat - 1) * 25 + b).alias("product_id"),
    )


def product_shelf_life(category_id, brand_no):
    return X.shelf_days_for(category_id) + brand_no % 3


def sales_lines(li: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    """lineitem joined to its product (part) and store (supplier -> nation -> region)."""
    li = li.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                   "l_returnflag", "l_shipdate")
    parts = _part_keys(part).select("p_partkey", "product_id")
    sup = (supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
           .select("s_suppkey", (F.col("n_regionkey") + 1).alias("store_id")))
    rows = (li.join(parts, F.col("l_partkey") == F.col("p_partkey"))
              .join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
              .where(F.col("product_id").isNotNull()))
    q = F.floor("l_quantity").cast("long")
    dpct = F.round(F.col("l_discount") * 100).cast("int")
    is_r = F.col("l_returnflag") == "R"
    return rows.select(
        "store_id", "product_id", X.retail_date("l_shipdate").alias("date"), q.alias("q"), dpct.alias("dpct"),
        (F.round(F.col("l_extendedprice") * 100).cast("long") * (F.lit(100) - dpct)).alias("rev"),
        F.when(is_r, X.idiv(q, F.lit(5))).otherwise(0).alias("w"),
        F.when(is_r & (F.col("l_linenumber") >= 5), X.idiv(q, F.lit(10))).otherwise(0).alias("dn"))


def daily_from_lines(lines: DataFrame) -> DataFrame:
    """daily_sales from sales lines: one row per (store, product, day)."""
    g = (lines.groupBy("store_id", "product_id", "date")
         .agg(F.sum("q").alias("quantity_sold"), F.sum("rev").alias("rev"),
              F.sum("w").alias("units_wasted"), F.sum("dn").alias("units_donated"),
              F.max("dpct").alias("max_dpct")))
    doy = F.dayofyear("date")
    mmdd = F.month("date") * 100 + F.dayofmonth("date")
    promo = F.col("max_dpct") >= 9
    return g.select(
        F.col("store_id").cast("int"), F.col("product_id").cast("int"), "date",
        F.col("quantity_sold").cast("int"),
        (X.idiv("rev", F.lit(100)).cast("decimal(16,0)") / 100).cast("decimal(14,2)").alias("revenue"),
        F.col("units_wasted").cast("int"), F.col("units_donated").cast("int"),
        (F.lit(30) + (F.lit(7) * doy) % 50).cast("double").alias("temperature_avg"),
        mmdd.isin(*X.HOLIDAYS_MMDD).alias("is_holiday"),
        promo.alias("is_promotion"),
        F.when(promo, F.col("max_dpct") / F.lit(100.0)).otherwise(F.lit(0.0)).alias("promotion_discount"),
        F.weekday("date").cast("int").alias("day_of_week"),
    )


def visit_posts(events: DataFrame) -> DataFrame:
    """Raw visit posts (headers and payload as they would arrive) from view / click events."""
    xff = F.when(F.col("event_id") % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                 (F.col("event_id") % 256).cast("string"), F.lit(", 172.16.0.1")))
    return (events.where(F.col("event_type").isin("view", "click"))
            .select(F.col("event_id").alias("visit_id"), F.col("ts").alias("received_at"),
                    "event_type", "user_id", xff.alias("x_forwarded_for"),
                    F.concat(F.lit("/"), "event_type").alias("path"),
                    F.col("props").alias("payload_json")))


_TABLES: dict = {}


def materialize(spark: SparkSession, key: tuple, build) -> DataFrame:
    """Write a derived table once per session as Parquet under the shared checkpoint
    folder and serve every later query from it (column pruning, pushed filters, and
    no lineage back to the raw scans). ``build`` returns the DataFrame to write."""
    import hashlib
    import os
    import uuid

    from freshlane.session import ensure_checkpoint_dir
    full = (spark.sparkContext.applicationId, *key)
    path = _TABLES.get(full)
    if path is None:
        tag = hashlib.sha1(repr(key).encode()).hexdigest()[:10]
        path = os.path.join(ensure_checkpoint_dir(spark), "tables", f"{key[-1]}-{tag}-{uuid.uuid4().hex[:8]}")
        build().write.mode("overwrite").parquet(path)
        _TABLES[full] = path
    return spark.read.parquet(path)


class Retail:
    """Derived retail tables over one driver data folder.

    With ``materialized=True`` (the default) the facts are derived once per
    session and written as Parquet tables; ``False`` keeps every table a pure
    plan over the raw scans (used to inspect the full physical plan).
    """

    def __init__(self, spark: SparkSession, sf_dir: str, materialized: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir
        self.materialized = materialized

    @cached_property
    def input_state(self) -> tuple:
        """What the driver tables hold now; derived tables are kept per state, so new files are seen."""
        return input_state(self.spark, self.sf_dir, ("region", "supplier", "part", "lineitem", "events", "orders"))

    def _table(self, name, build) -> DataFrame:
        if not self.materialized:
            return build()
        parts = name if isinstance(name, tuple) else (name,)
        return materialize(self.spark, (self.sf_dir, self.input_state, *parts[1:], parts[0]), build)

    def raw(self, name: str, *cols: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name, *cols)

    # ---- dimensions -------------------------------------------------------------
    @cached_property
    def stores(self) -> DataFrame:
        r = self.raw("region", "r_regionkey", "r_name")
        stype = F.element_at(F.array(*[F.lit(t) for t in X.STORE_TYPES]),
                             (F.col("r_regionkey") % 3 + 1).cast("int"))
        return r.select(
            (F.col("r_regionkey") + 1).cast("int").alias("store_id"),
            F.col("r_name").alias("name"),
            F.col("r_name").alias("location"),
            (F.lit(18000) + F.lit(8000) * F.col("r_regionkey")).cast("int").alias("size_sqft"),
            stype.alias("type"),
        )

    @cached_property
    def categories(self) -> DataFrame:
        return self._table("categories", self._categories)

    def _categories(self) -> DataFrame:
        cat = X.category_index("p_type")
        return (self.raw("part", "p_type").distinct()
                .select(cat.cast("int").alias("category_id"), F.col("p_type").alias("name"))
                .where(F.col("category_id").isNotNull())
                .select("category_id", "name",
                        F.when(F.col("category_id") <= 3, "high").otherwise("low").alias("perishability"),
                        X.shelf_days_for(F.col("category_id")).cast("int").alias("avg_shelf_days")))

    @cached_property
    def products(self) -> DataFrame:
        """One product per (p_type, p_brand); at most 6 x 25 = 150 rows."""
        return self._table("products", self._products)

    def _products(self) -> DataFrame:
        pk = _part_keys(self.raw("part", "p_partkey", "p_type", "p_brand", "p_retailprice"))
        g = (pk.where(F.col("product_id").isNotNull())
             .groupBy("product_id", "category_id", "brand_no", "p_type", "p_brand")
             .agg(F.min(F.round(F.col("p_retailprice") * 100)).cast("long").alias("unit_cents")))
        cost_cents = X.idiv(F.col("unit_cents") * (F.lit(50) + F.col("brand_no")), F.lit(100))
        temp = (F.when(F.col("category_id") <= 2, "cold")
                 .when(F.col("category_id") <= 4, "ambient").otherwise("frozen"))
        return g.select(
            F.col("product_id").cast("int").alias("product_id"),
            F.col("category_id").cast("int").alias("category_id"),
            F.concat_ws(" ", "p_type", "p_brand").alias("name"),
            (F.col("unit_cents").cast("decimal(12,0)") / 100).cast("decimal(8,2)").alias("unit_price"),
            (cost_cents.cast("decimal(12,0)") / 100).cast("decimal(8,2)").alias("cost_price"),
            product_shelf_life(F.col("category_id"), F.col("brand_no")).cast("int").alias("shelf_life_days"),
            temp.alias("storage_temp"),
        )

    # ---- facts ------------------------------------------------------------------
    def sales_lines(self, lineitem: DataFrame | None = None) -> DataFrame:
        """Line-level sales keyed by (store, product, day); ``lineitem`` may be a stream."""
        li = lineitem if lineitem is not None else self.raw("lineitem")
        return sales_lines(li, self.raw("part", "p_partkey", "p_type", "p_brand", "p_retailprice"),
                           self.raw("supplier", "s_suppkey", "s_nationkey"),
                           self.raw("nation", "n_nationkey", "n_regionkey"))

    @cached_property
    def daily_sales(self) -> DataFrame:
        return self._table("daily_sales", lambda: daily_from_lines(self.sales_lines()))

    @cached_property
    def inventory_snapshots(self) -> DataFrame:
        return self._table("inventory_snapshots", self._inventory)

    def _inventory(self) -> DataFrame:
        s = self.daily_sales
        doy = F.dayofyear("date")
        cat = X.idiv(F.col("product_id") - 1, F.lit(25)) + 1
        brand = F.pmod(F.col("product_id") - 1, F.lit(25)) + 1
        shelf = product_shelf_life(cat, brand)
        keep = ~(((F.lit(7) * F.col("store_id") + F.lit(3) * F.col("product_id") + doy) % 10) == 0)
        expiry = F.when(((F.col("product_id") + doy) % 17) == 0, F.lit(None).cast("int")) \
            .otherwise(F.greatest(F.lit(1), shelf - X.days_since_epoch("date") % shelf))
        return s.where(keep).select(
            "store_id", "product_id", "date",
            ((F.lit(2) * F.col("quantity_sold") + F.lit(13) * doy + F.lit(7) * F.col("product_id")) % 120)
            .cast("int").alias("quantity_on_hand"),
            expiry.cast("int").alias("days_until_expiry"),
            (F.lit(30) + F.col("product_id") % 40).cast("int").alias("reorder_point"),
            F.date_sub("date", (doy % 5).cast("int")).alias("last_delivery_date"),
        )

    # ---- event logs -------------------------------------------------------------
    @cached_property
    def alerts(self) -> DataFrame:
        e = self.raw("events", "event_id", "ts", "user_id", "event_type", "value", "props")
        atype = X.case_map("event_type", {"error": "data_drift", "signup": "model_promoted",
                                          "purchase": "retrain_completed"})
        sev = F.when(F.col("event_type") == "error",
                     F.when(F.col("value") > 50, "high").otherwise("medium")).otherwise("info")
        return (e.where(F.col("event_type").isin("error", "signup", "purchase"))
                .select(F.col("event_id").alias("alert_id"), atype.alias("alert_type"),
                        sev.alias("severity"),
                        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("message"),
                        F.col("props").alias("metadata_json"),
                        ((F.col("event_id") % 3) == 0).alias("acknowledged"),
                        F.col("ts").alias("created_at")))

    @cached_property
    def site_visit_events(self) -> DataFrame:
        """Raw visit posts: headers and payload as they would arrive."""
        return visit_posts(self.raw("events", "event_id", "ts", "user_id", "event_type", "props"))
