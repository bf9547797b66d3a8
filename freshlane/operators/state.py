"""State changes as DataFrame rewrites (S3..S12, I4).

Parquet has no row-level MERGE, so an upsert is a rewrite: a full outer join
of the existing rows and the new ones on the key (one shuffle on the key),
taking the new value columns where a new row exists and keeping the old
created_at / actuals. ``operators/durable.py`` does so on stored tables: only the
touched months are read and rewritten, and a commit swaps them in (``sources/monthly.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshlane.config import FEATURE_COLUMNS

# Feature-store column types: the fixed scales, with room for far larger sums (flags are booleans).
FEATURE_STORE_TYPES = {
    "day_of_week": "int", "day_of_month": "int", "week_of_year": "int", "month": "int",
    "is_weekend": "boolean", "is_month_start": "boolean", "is_month_end": "boolean",
    "sales_lag_1d": "decimal(16,2)", "sales_lag_7d": "decimal(16,2)", "sales_lag_14d": "decimal(16,2)",
    "sales_lag_28d": "decimal(16,2)", "waste_lag_1d": "decimal(16,2)", "waste_lag_7d": "decimal(16,2)",
    "inventory_lag_1d": "decimal(16,2)",
    "sales_rolling_7d_mean": "decimal(16,2)", "sales_rolling_7d_std": "decimal(16,2)",
    "sales_rolling_14d_mean": "decimal(16,2)", "sales_rolling_28d_mean": "decimal(16,2)",
    "waste_rolling_7d_sum": "decimal(16,2)", "waste_rolling_7d_rate": "decimal(16,4)",
    "revenue_rolling_7d": "decimal(18,2)", "sales_rolling_7d_median": "decimal(16,2)",
    "unit_price": "decimal(8,2)", "cost_price": "decimal(8,2)", "shelf_life_days": "int",
    "margin_pct": "decimal(6,4)", "category_encoded": "int",
    "is_holiday": "boolean", "is_promotion": "boolean", "promotion_discount": "decimal(4,2)",
    "temperature_avg": "decimal(4,1)", "store_type_encoded": "int",
    "days_since_last_promo": "int", "stock_to_sales_ratio": "decimal(16,4)",
    "days_until_expiry_norm": "decimal(6,4)",
}
KEYS3 = ["store_id", "product_id", "date"]


def exact_margin4() -> "F.Column":
    """margin_pct to 4 dp, rounded half up in integer cents (no binary ties)."""
    from freshlane.functions.exprs import idiv
    u = F.round(F.col("unit_price") * 100).cast("long")
    c = F.round(F.col("cost_price") * 100).cast("long")
    q = F.when(u == 0, F.lit(0)).otherwise(idiv((u - c) * 20000 + u, F.lit(2) * u))
    return (q.cast("decimal(12,0)") / 10000).cast("decimal(6,4)")


def feature_store_projection(features: DataFrame) -> DataFrame:
    """S3: keys + the 35 features in the feature store's column types."""
    from freshlane.functions.exprs import to_dec

    def conv(c):
        t = FEATURE_STORE_TYPES[c]
        if c == "margin_pct":
            return exact_margin4()
        if t.startswith("decimal"):
            p_, s_ = (int(x) for x in t[8:-1].split(","))
            return to_dec(F.col(c), p_, s_)
        return F.col(c).cast(t)
    return features.select(*KEYS3, *[conv(c).alias(c) for c in FEATURE_COLUMNS])


def save_features(features: DataFrame, path: str, mode: str = "overwrite") -> int:
    """S3 sink: write the projection partitioned by month (pruned by date filters); the rows written."""
    from pyspark.sql import Observation
    seen = Observation()
    fs = feature_store_projection(features).withColumn("ym", F.date_format("date", "yyyy-MM"))
    fs.observe(seen, F.count(F.lit(1)).alias("n")).write.mode(mode).partitionBy("ym").parquet(path)
    return seen.get["n"]


def load_features(spark, path: str, store_id=None, date_from=None, date_to=None) -> DataFrame:
    """Scan of a saved feature store with optional inclusive predicates, sorted."""
    return select_features(spark.read.parquet(path), store_id, date_from, date_to).drop("ym")


def select_features(df: DataFrame, store_id=None, date_from=None, date_to=None) -> DataFrame:
    """The given predicates, all of them, on a feature-store table (pushed to Parquet / partitions); sorted by key."""
    if store_id is not None:
        df = df.where(F.col("store_id") == store_id)
    if date_from is not None:
        df = df.where(F.col("date") >= F.lit(date_from).cast("date"))
    if date_to is not None:
        df = df.where(F.col("date") <= F.lit(date_to).cast("date"))
    return df.orderBy(*KEYS3)


def load_verification(ctx) -> DataFrame:
    """Row count per table and the revenue / waste / donated sums of daily_sales."""
    counts = None
    for name in ("stores", "categories", "products", "daily_sales", "inventory_snapshots", "alerts"):
        c = getattr(ctx, name).agg(F.count(F.lit(1)).cast("long").alias("n")).select(
            F.lit(name).alias("item"), F.col("n").cast("double").alias("value"))
        counts = c if counts is None else counts.unionByName(c)
    s = ctx.daily_sales.agg(F.sum("revenue").alias("r"), F.sum("units_wasted").alias("w"),
                            F.sum("units_donated").alias("d"))
    sums = s.select(F.explode(F.array(
        F.struct(F.lit("total_revenue").alias("item"), F.col("r").cast("double").alias("value")),
        F.struct(F.lit("total_wasted").alias("item"), F.col("w").cast("double").alias("value")),
        F.struct(F.lit("total_donated").alias("item"), F.col("d").cast("double").alias("value")))).alias("x")
    ).select("x.*")
    return counts.unionByName(sums)


PRED_KEY = ["store_id", "product_id", "date", "model_version"]
PRED_VALUES = ["predicted_demand", "confidence_lower", "confidence_upper", "waste_risk_score", "waste_risk_tier"]


def upsert_predictions(existing: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Insert (created ``now``); on key conflict overwrite the 5 value columns, keep created_at and actuals."""
    now = F.localtimestamp() if now is None else now
    cols = existing.columns
    old = existing.select(*PRED_KEY, F.struct(*[c for c in cols if c not in PRED_KEY]).alias("o"))
    nw = new.select(*PRED_KEY, F.struct(*PRED_VALUES).alias("n"))
    j = old.join(nw, PRED_KEY, "full_outer")
    out = []
    for c in cols:
        if c in PRED_KEY:
            out.append(F.col(c))
        elif c in PRED_VALUES:
            out.append(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c != "waste_risk_tier"
                       else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        elif c == "created_at":
            out.append(F.coalesce(F.col("o.created_at"), now).alias(c))
        else:
            out.append(F.col(f"o.{c}").alias(c))
    return j.select(*out)


def record_actuals(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """Set actual and forecast_error on every version whose actual is still NULL.

    ``actuals`` is (store_id, product_id, date, actual_sold), one row per key.
    """
    from freshlane.operators.scoring import forecast_error
    a = actuals.select("store_id", "product_id", "date", F.col("actual_sold").cast("int").alias("_a"))
    j = predictions.join(a, KEYS3, "left")
    fill = F.col("actual_demand").isNull() & F.col("_a").isNotNull()
    return j.select(*[
        F.when(fill, F.col("_a")).otherwise(F.col("actual_demand")).alias(c) if c == "actual_demand"
        else F.when(fill, forecast_error(F.col("predicted_demand"), F.col("_a"))).otherwise(F.col(c)).alias(c)
        if c == "forecast_error" else F.col(c)
        for c in predictions.columns])


def update_with_actuals(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """I4's write: of each posted (store, product, date) the newest prediction gets the actual and the error
    (4 dp), whatever it held; all other rows stay. ``items`` has one row per key."""
    a = items.select(*KEYS3, F.col("actual_sold").cast("int").alias("_a"))
    newest = predictions.join(a, KEYS3).groupBy(*KEYS3).agg(
        F.max_by("model_version", "created_at").alias("model_version"), F.first("_a").alias("_a"))
    p, m = F.col("predicted_demand").cast("double"), F.col("_a").cast("double")
    err = F.round((p - m) / F.greatest(m, F.lit(1.0)), 4)
    new = {"actual_demand": F.coalesce("_a", "actual_demand"),
           "forecast_error": F.when(F.col("_a").isNotNull(), err.cast(predictions.schema["forecast_error"].dataType))
           .otherwise(F.col("forecast_error"))}
    j = predictions.join(newest, [*KEYS3, "model_version"], "left")
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in predictions.columns])


def apply_actuals_batch(predictions: DataFrame, items: DataFrame) -> DataFrame:
    """I4: per item, the newest prediction for (store, product, date); error % to 1 dp;
    that version's actual and error (4 dp) are updated. Returns the per-item result."""
    from freshlane.operators.asof import latest_by
    latest = latest_by(predictions.select(*KEYS3, "model_version", "predicted_demand", "created_at"),
                       KEYS3, "created_at")
    j = items.join(latest, KEYS3)
    p = F.col("predicted_demand").cast("double")
    a = F.col("actual_sold").cast("double")
    err_pct = F.round(F.abs(p - a) / F.greatest(a, F.lit(1.0)) * 100, 1)
    return j.select(*KEYS3, "model_version", F.col("actual_sold").cast("int").alias("actual_sold"),
                    p.alias("predicted_demand"), err_pct.alias("error_pct"),
                    F.round((p - a) / F.greatest(a, F.lit(1.0)), 4).alias("forecast_error"))


VISIT_COLUMNS = ("source", "ip", "city", "region", "country", "latitude", "longitude", "path", "user_agent", "referrer",
                 "payload_json")


def site_visit_normalize(raw: DataFrame, ua_limit: int = 512, ref_limit: int = 256) -> DataFrame:
    """IP = payload ip, else first X-Forwarded-For hop (trimmed), else X-Real-IP, else
    client host; source and place as posted; the posted referrer, else the header's; user agent and header
    referrer cut to N chars, '' when absent; payload JSON kept as posted."""
    payload_ip = F.get_json_object("payload_json", "$.ip")
    xff_first = F.trim(F.split(F.col("x_forwarded_for"), ",").getItem(0))
    cols = set(raw.columns)
    real_ip = F.col("x_real_ip") if "x_real_ip" in cols else F.lit(None).cast("string")
    client = F.col("client_host") if "client_host" in cols else F.lit(None).cast("string")
    ua = F.col("user_agent") if "user_agent" in cols else F.lit(None).cast("string")
    ref = F.col("referrer") if "referrer" in cols else F.lit(None).cast("string")
    posted = lambda name: F.get_json_object("payload_json", f"$.{name}")
    ip = F.coalesce(F.nullif(payload_ip, F.lit("")), F.nullif(xff_first, F.lit("")),
                    F.nullif(real_ip, F.lit("")), client)
    return raw.select("visit_id", "received_at", posted("source").alias("source"), ip.alias("ip"),
                      posted("city").alias("city"), posted("region").alias("region"), posted("country").alias("country"),
                      F.expr("try_cast(get_json_object(payload_json, '$.latitude') AS double)").alias("latitude"),
                      F.expr("try_cast(get_json_object(payload_json, '$.longitude') AS double)").alias("longitude"),
                      "path", F.substring(F.coalesce(ua, F.lit("")), 1, ua_limit).alias("user_agent"),
                      F.coalesce(F.nullif(posted("referrer"), F.lit("")),
                                 F.substring(F.coalesce(ref, F.lit("")), 1, ref_limit)).alias("referrer"),
                      F.col("payload_json"))


# The fields of a posted visit, and the greatest length of the texts among them.
VISIT_FIELDS = ("source string, ip string, city string, region string, country string, latitude double, longitude double, "
                "path string, referrer string")
VISIT_LENGTHS = {"source": 20, "ip": 45, "city": 100, "region": 100, "country": 100, "path": 256, "referrer": 256}


def site_visits_posted(raw: DataFrame, ua_limit: int = 512, ref_limit: int = 256) -> DataFrame:
    """S10 on whole posts: the payload is parsed once; fields it does not declare, and fields that are null, are not kept.

    ``payload_json`` is the accepted payload without nulls; ``reason`` tells why a post is rejected: ``payload`` (no
    JSON object) or the first field that is too long. Rejected posts are rows too, so that none is lost.
    """
    cols = set(raw.columns)
    header = lambda c: F.col(c) if c in cols else F.lit(None).cast("string")
    posted = raw.withColumn("_p", F.from_json("payload_json", VISIT_FIELDS + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    field = lambda c: F.col(f"_p.{c}")
    some = lambda c: F.nullif(c, F.lit(""))
    forwarded = F.trim(F.split(header("x_forwarded_for"), ",").getItem(0))
    hop = F.when(some(header("x_forwarded_for")).isNotNull(), forwarded).otherwise(
        F.coalesce(some(F.trim(header("x_real_ip"))), header("client_host")))
    parsed = F.coalesce(F.trim("payload_json").startswith("{"), F.lit(False)) & field("_bad").isNull()
    names = [x.split()[0] for x in VISIT_FIELDS.split(", ")]
    reason = F.when(~parsed, "payload")
    for name, most in VISIT_LENGTHS.items():
        reason = reason.when(F.length(field(name)) > most, name)
    return posted.select(
        "visit_id", "received_at", F.coalesce(some(field("ip")), hop).alias("ip"),
        *[field(c).alias(c) for c in ("source", "city", "region", "country", "latitude", "longitude", "path")],
        F.substring(F.coalesce(header("user_agent"), F.lit("")), 1, ua_limit).alias("user_agent"),
        F.coalesce(some(field("referrer")), F.substring(F.coalesce(header("referrer"), F.lit("")), 1, ref_limit)).alias("referrer"),
        F.when(parsed, F.to_json(F.struct(*[field(c).alias(c) for c in names]))).alias("payload_json"), reason.alias("reason"))


def train_metrics_row(demand_metrics: DataFrame, waste_metrics: DataFrame, baselines: DataFrame,
                      elapsed_sec: float) -> DataFrame:
    """The one-row training summary (demand MAPE / RMSE, waste AUC / F1, naive lag-7 MAPE)."""
    d = demand_metrics.where(F.col("model") == "ensemble")
    nl = demand_metrics.where(F.col("model") == "naive_lag7")
    w = waste_metrics.where(F.col("split") == "test")
    one = d.select(F.col("mape").alias("demand_mape"), F.col("rmse").alias("demand_rmse"))
    return one.select(
        "demand_mape", "demand_rmse",
        w.select("auc_roc").scalar().alias("waste_auc"), w.select("f1").scalar().alias("waste_f1"),
        nl.select("mape").scalar().alias("naive_lag7_mape"),
        F.lit(round(float(elapsed_sec), 3)).alias("elapsed_sec"))


def write_metrics_json(row: DataFrame, path: str) -> None:
    """S11 sink: one JSON object (single output file: the frame has one row)."""
    row.coalesce(1).write.mode("overwrite").json(path)
