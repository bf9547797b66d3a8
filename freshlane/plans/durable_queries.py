"""Registry entries: durable merges (S6, S7, M8), feature appends (F0, S3), event-time streams (T1..T3), retraining."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from freshlane.functions.exprs import round6
from freshlane.operators import durable as D
from freshlane.operators import features as FE
from freshlane.operators import state as ST
from freshlane.plans.catalog import register
from freshlane.sources.bucketed import store_series
from freshlane.sources.monthly import new_root
from freshlane.streaming import event_time as ET
from freshlane.streaming.streams import run_once, stream_dirs

KEYS3 = ["store_id", "product_id", "date"]


def _store(ctx):
    return D.predictions_store(ctx.spark, new_root(ctx.spark, "predictions"), ctx.predictions)


def _out(predictions):
    """Every column of every row."""
    numbers = ("predicted_demand", "confidence_lower", "confidence_upper", "waste_risk_score", "forecast_error")
    return predictions.select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in predictions.columns])


def _last(ctx):
    return ctx.daily_sales.agg(F.max("date").alias("d")).select("d").scalar()


def _daily_forecast_upsert(ctx):
    """M8 for a week before the last day, run twice: the second run changes nothing."""
    table = _store(ctx)
    target = F.date_sub(_last(ctx), 7)
    for hour in (6, 9):
        D.run_daily_forecast(table, ctx.features, target, target.cast("timestamp_ntz") + F.make_interval(hours=F.lit(hour)), ctx.config)
    return _out(table.read())


def _upsert_whole(ctx):
    """S6 on the stored table: v1 of the last 7 days gets new values, and as v3, a new version, rows are inserted."""
    table = _store(ctx)
    last = _last(ctx)
    v1 = ctx.predictions.where((F.col("date") > F.date_sub(last, 7)) & (F.col("model_version") == "v1")).withColumn(
        "predicted_demand", F.col("confidence_upper"))
    new = v1.unionByName(v1.withColumn("model_version", F.lit("v3"))).select(*ST.PRED_KEY, *ST.PRED_VALUES)
    D.upsert(table, new, last.cast("timestamp_ntz"))
    return _out(table.read())


def _record_whole(ctx):
    """S7 on the stored table: the sales of the last 3 days, posted twice."""
    table = _store(ctx)
    items = ctx.daily_sales.where(F.col("date") > F.date_sub(_last(ctx), 3)).select(*KEYS3, F.col("quantity_sold").alias("actual_sold"))
    for _ in range(2):
        D.record(table, items)
    return _out(table.read())


register("daily_forecast_upsert", _daily_forecast_upsert)
register("upsert_predictions_whole", _upsert_whole)
register("record_actuals_whole", _record_whole)

#: The key appends so many last days, one by one.
APPENDED_DAYS = 10


def _features_append(ctx):
    """F1..F7 of all days up to the last ten, then these ten appended one by one."""
    sales, inventory = ctx.daily_sales, ctx.inventory_snapshots
    last = sales.agg(F.max("date").alias("d")).first()["d"]
    table = D.FeatureTable(ctx.spark, new_root(ctx.spark, "features"), ctx.products, ctx.stores)
    for back in range(APPENDED_DAYS, -1, -1) if last else ():
        day = last - dt.timedelta(days=back)
        part = (F.col("date") <= F.lit(day)) if back == APPENDED_DAYS else (F.col("date") == F.lit(day))
        table.append(sales.where(part), inventory.where(part), (day - dt.date(1970, 1, 1)).days)
    found = table.read() if last else FE.build_features(sales, ctx.products, inventory, ctx.stores, fill=False)
    return found.select(*KEYS3, *[round6(c).alias(c) for c in FE.FEATURE_COLUMNS])


register("features_append", _features_append)


def stored_features(ctx, buckets: int = 16):
    """F1..F7 from the stored series: no exchange."""
    table = store_series(ctx.spark, ctx.daily_sales, ctx.inventory_snapshots, buckets)
    return FE.features_of(FE.base_of(ctx.spark.table(table)), ctx.products, ctx.stores)


register("features_stored", lambda ctx: stored_features(ctx).select(*KEYS3, *[round6(c).alias(c) for c in FE.FEATURE_COLUMNS]))


# ---- streams
#: Days may arrive so much later than the newest one and still count as on time.
DAY = 86_400


def _stream_predictions(ctx):
    """Predictions after all sales have arrived as actuals."""
    table = _store(ctx)
    _, ckpt = stream_dirs(ctx.spark, "actuals")
    totals = ET.totals_table(ctx.spark, new_root(ctx.spark, "actuals"))
    run_once(ET.run_actuals(ctx.spark, ctx.sf_dir, totals, table, ckpt))
    return _out(table.read())


def _stream_day_windows(ctx):
    """Sums per store and day from closed windows, open windows and late rows."""
    out, ckpt = stream_dirs(ctx.spark, "day-windows")
    rows = ET.sales_events(ctx.spark, ctx.sf_dir)
    ET.run_day_windows(ctx.spark, rows, out, ckpt, 30 * DAY)
    return ET.read_day_windows(ctx.spark, out, rows.schema)


def _stream_visits_once(ctx):
    """T1 with bounded state."""
    out, ckpt = stream_dirs(ctx.spark, "visits")
    rows = ET.visit_events(ctx.spark, ctx.sf_dir)
    ET.run_visits(ctx.spark, rows, out, ckpt, DAY)
    return ET.read_visits(ctx.spark, out, rows.schema).select(
        "visit_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), *ST.VISIT_COLUMNS)


register("stream_predictions", _stream_predictions)
register("stream_day_windows", _stream_day_windows)
register("stream_visits_once", _stream_visits_once)


# ---- visits with whole payloads
def _site_visit_payload(ctx):
    """S10 on posts whose payloads hold nulls, fields of other names, texts that are too long, and text that is no JSON."""
    e = ctx.raw("events", "event_id", "ts", "user_id", "event_type")
    i, u = F.col("event_id"), F.col("user_id")
    some = lambda test, value: F.when(test, value)
    payload = F.struct(
        F.col("event_type").alias("source"), some(i % 4 == 0, F.concat(F.lit("10.1.0."), (u % 256).cast("string"))).alias("ip"),
        some(i % 3 != 0, F.concat(F.lit("city "), (u % 7).cast("string"))).alias("city"),
        F.lit(None).cast("string").alias("region"), some(i % 2 == 0, F.repeat(F.lit("x"), (u % 120).cast("int"))).alias("country"),
        some(i % 5 != 0, (u % 90).cast("double") + 0.5).alias("latitude"), i.alias("session"),
        some(i % 7 == 0, F.lit("")).alias("referrer"))
    posts = e.select(
        i.alias("visit_id"), F.col("ts").alias("received_at"),
        F.when(i % 6 == 0, F.concat(F.lit(" 10.0.0."), (u % 256).cast("string"), F.lit(" , 172.16.0.1"))).alias("x_forwarded_for"),
        F.when(i % 9 == 0, F.lit("/start")).alias("referrer"),
        F.when(i % 11 == 0, F.lit("no json")).otherwise(F.to_json(payload, {"ignoreNullFields": "false"})).alias("payload_json"))
    return ST.site_visits_posted(posts)


register("site_visit_payload", _site_visit_payload)


# ---- drift with exact p-values
def _ks_exact(ctx):
    """R2 as the reference's library has it: exact up to 10,000 rows a side, the limit law beyond (no SQL: path counts)."""
    from freshlane.operators import monitor as MO
    from freshlane.plans.operator_queries_more import _drift_inputs
    return MO.ks(MO.long_samples(*_drift_inputs(ctx)), exact=True).select(
        "feature", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("p", 6).alias("p_value"))


register("ks_exact", _ks_exact)


# ---- retraining
def _retrain_cycle(ctx):
    """A first cycle (no champion) and a second one against it, few rounds each, and their alerts (Spark ML, rows only)."""
    from freshlane.operators import models as M
    from freshlane.operators import retrain as RT
    store = RT.ModelStore(ctx.spark, new_root(ctx.spark, "models"))
    log = RT.alert_log(ctx.spark, new_root(ctx.spark, "alerts"))
    found = None
    for cycle, rounds in ((1, 5), (2, 10)):
        now = (F.date_add(_last(ctx), cycle)).cast("timestamp_ntz")
        row = RT.retrain(ctx.features, store, log, now, M.ModelParams(
            gbt_iter=rounds, gbt_step=0.2, rf_trees=rounds, waste_iter=rounds), ctx.config).withColumn("cycle", F.lit(cycle))
        found = row if found is None else found.unionByName(row)
    alerts = log.read().select(F.datediff("date", _last(ctx)).alias("cycle"), "severity", "metadata_json", "acknowledged")
    return found.join(alerts, "cycle")


register("retrain_cycle", _retrain_cycle)
