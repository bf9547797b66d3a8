"""Registry entries: labels, splits, scoring, as-of lookups, rules, feature-store state."""

from __future__ import annotations

from pyspark.sql import functions as F

from freshlane.functions import exprs as X_
from freshlane.functions.exprs import round6
from freshlane.operators import asof as A
from freshlane.operators import labels as L
from freshlane.operators import rules as R
from freshlane.operators import scoring as S
from freshlane.plans.catalog import register

KEYS = ["store_id", "product_id"]
KEYS3 = ["store_id", "product_id", "date"]

# ---- labels and splits (L1..L7) -------------------------------------------------------------
register("waste_labels", lambda ctx: L.waste_labels(ctx.daily_sales))
register("waste_labels_forward", lambda ctx: L.waste_labels_forward(ctx.daily_sales))
register("time_split", lambda ctx: L.time_split(ctx.daily_sales, ctx.config))
register("retrain_split", lambda ctx: L.retrain_split(ctx.daily_sales, ctx.config))
register("class_balance", lambda ctx: L.class_balance(
    L.add_split(L.add_waste_label(ctx.daily_sales), ctx.daily_sales, ctx.config)))
register("serving_vectors", lambda ctx: L.serving_vectors(ctx.features).select(
    *KEYS3, *[round6(c).alias(c) for c in L.FEATURE_COLUMNS]))


# ---- deterministic scoring (M2, M3, M6, M7 on the baseline scorers) -----------------------------
def _pred_out(df):
    return df.select(*KEYS3, *[F.col(c).cast("double").alias(c) for c in
                               ("predicted_demand", "confidence_lower", "confidence_upper", "waste_risk_score")],
                     "waste_risk_tier")


register("score_demand", lambda ctx: S.score_frame(ctx.features, ctx.config)
         .select(*KEYS3, F.col("predicted_demand").cast("double").alias("predicted_demand")))
register("score_demand_intervals", lambda ctx: S.score_frame(ctx.features, ctx.config).select(
    *KEYS3, *[F.col(c).cast("double").alias(c) for c in ("predicted_demand", "confidence_lower",
                                                          "confidence_upper")]))
register("score_waste", lambda ctx: S.score_frame(ctx.features, ctx.config)
         .select(*KEYS3, F.col("waste_risk_score").cast("double").alias("waste_risk_score")))
register("risk_tiers", lambda ctx: S.score_frame(ctx.features, ctx.config)
         .groupBy("waste_risk_tier").agg(F.count(F.lit(1)).cast("long").alias("n")))


def _predictions_out(ctx):
    p = ctx.predictions
    return p.select(*KEYS3, "model_version",
                    *[F.col(c).cast("double").alias(c) for c in ("predicted_demand", "confidence_lower",
                                                                 "confidence_upper", "waste_risk_score")],
                    "waste_risk_tier", "actual_demand", F.col("forecast_error").cast("double").alias("forecast_error"),
                    "created_at")


register("predictions_table", _predictions_out)


def _daily_forecast(ctx, target_date=None):
    """M8: every pair's latest feature row on or before the target date, scored (v1)."""
    f = ctx.features
    target = (F.lit(target_date).cast("date") if target_date
              else F.date_sub(f.agg(F.max("date").alias("d")).select("d").scalar(), 7))
    latest = A.latest_by(f.where(F.col("date") <= target), KEYS, "date")
    out = S.score_frame(latest, ctx.config)
    return _pred_out(out).withColumnRenamed("date", "feature_date")


register("daily_forecast", _daily_forecast)


def _batch_requests(ctx):
    """Request frame derived from the data: every sale three days on (exercises both A2 paths)."""
    return ctx.daily_sales.select(*KEYS, F.date_add("date", 3).alias("date")).distinct()


def _batch_predict(ctx):
    """M9: requests -> exact-or-latest feature row (A2) -> demand, 1 dp."""
    r = A.exact_or_latest(_batch_requests(ctx), ctx.features, KEYS, "date", "date",
                          ["sales_rolling_7d_mean"])
    return r.select(*KEYS, "date", "match_kind", "matched_date",
                    F.round(F.col("sales_rolling_7d_mean"), 1).alias("predicted_demand"))


register("batch_predict", _batch_predict)

# ---- as-of lookups (A1..A5) ----------------------------------------------------------------------
_ASOF_COLS = ["sales_rolling_7d_mean", "waste_rolling_7d_rate", "stock_to_sales_ratio"]


def _asof_backward(ctx):
    """A1: per pair, latest feature row with date <= (last date - 7); pairs with none skipped."""
    f = ctx.features
    target = F.date_sub(f.agg(F.max("date").alias("d")).select("d").scalar(), 7)
    latest = A.latest_by(f.where(F.col("date") <= target).select(*KEYS3, *_ASOF_COLS), KEYS, "date")
    return latest.select(*KEYS3, *[round6(c).alias(c) for c in _ASOF_COLS])


register("asof_backward_features", _asof_backward)


def _exact_or_latest(ctx):
    r = A.exact_or_latest(_batch_requests(ctx), ctx.features, KEYS, "date", "date", _ASOF_COLS)
    return r.select(*KEYS, "date", "match_kind", "matched_date", *[round6(c).alias(c) for c in _ASOF_COLS])


register("exact_or_latest_features", _exact_or_latest)


def _nearest(ctx):
    r = A.nearest(_batch_requests(ctx), ctx.features, KEYS, "date", "date", _ASOF_COLS)
    return r.select(*KEYS, "date", "matched_date", *[round6(c).alias(c) for c in _ASOF_COLS])


register("nearest_features", _nearest)
register("latest_inventory", lambda ctx: A.latest_by(
    ctx.inventory_snapshots.select(*KEYS3, "quantity_on_hand", "days_until_expiry"), KEYS, "date"))
register("latest_features", lambda ctx: A.latest_by(
    ctx.features.select(*KEYS3, *_ASOF_COLS), KEYS, "date").select(
    *KEYS3, *[round6(c).alias(c) for c in _ASOF_COLS]))


def _latest_prediction(ctx):
    """A5: per (store, product, date) the newest prediction by created_at."""
    p = ctx.predictions.select(*KEYS3, "model_version", "predicted_demand", "created_at")
    r = A.latest_by(p, KEYS3, "created_at")
    return r.select(*KEYS3, "model_version", F.col("predicted_demand").cast("double").alias("predicted_demand"),
                    "created_at")


register("latest_prediction", _latest_prediction)


# ---- rules (C1..C13) -------------------------------------------------------------------------------
def _money(c):
    return F.col(c).cast("double").alias(c)


register("waste_request_features", lambda ctx: R.waste_request_features(ctx).select(
    *KEYS3, "current_stock", "days_until_expiry", "matched_date",
    round6("days_until_expiry_norm").alias("days_until_expiry_norm"),
    round6("stock_to_sales_ratio").alias("stock_to_sales_ratio")))
register("waste_risk_report", lambda ctx: R.waste_risk_report(ctx))
register("recommendation_inputs", lambda ctx: R.recommendation_inputs(ctx).select(
    *KEYS3, "product_name", _money("unit_price"), _money("cost_price"), _money("predicted_demand"),
    _money("waste_risk_score"), "current_stock", "days_until_expiry"))
register("action_candidates", lambda ctx: R.action_candidates(R.recommendation_inputs_daily(ctx)).select(
    *KEYS3, "action", "excess"))
register("markdown_pct", lambda ctx: R.recommendation_inputs(ctx).select(
    *KEYS, F.col("waste_risk_score").cast("double").alias("waste_risk_score"), "days_until_expiry",
    R.markdown_pct(F.col("waste_risk_score"), F.col("days_until_expiry")).cast("int").alias("markdown_pct")))


def _rec_out(df):
    return df.select(*KEYS3, "action", *(["priority"] if "priority" in df.columns else []), "description",
                     "waste_reduction_units", _money("revenue_impact_usd"), _money("waste_cost_saved_usd"),
                     _money("confidence"), "markdown_pct")


register("action_impacts", lambda ctx: _rec_out(
    R.action_impacts(R.action_candidates(R.recommendation_inputs_daily(ctx)))))
register("recommendations", lambda ctx: _rec_out(R.recommendations(ctx)))
register("ranked_recommendations", lambda ctx: _rec_out(R.recommendations_daily(ctx)))
register("recommendation_inputs_daily", lambda ctx: R.recommendation_inputs_daily(ctx).select(
    *KEYS3, _money("predicted_demand"), _money("waste_risk_score"), "current_stock", "days_until_expiry"))
register("recommendation_counts", lambda ctx: R.recommendations_daily(ctx).groupBy("action")
         .agg(F.count(F.lit(1)).cast("long").alias("n")))
register("recommendations_nested", lambda ctx: R.recommendations_nested(R.recommendations_daily(ctx)).select(
    *KEYS3, "waste_risk_score", "waste_risk_tier",
    F.to_json("recommendations").alias("recommendations_json")))  # the API's JSON payload


def _log_out(ctx):
    r = ctx.recommendations_log
    return r.select("rec_id", *KEYS3, "action_type", "markdown_pct", "expected_waste_reduction",
                    _money("expected_cost_saved_usd"), "status", "actual_waste_reduction",
                    _money("actual_cost_saved_usd"), "created_at")


register("recommendations_log_rows", _log_out)


# ---- evaluation (E1..E8) ---------------------------------------------------------------------------
from freshlane.operators import evaluate as E  # noqa: E402
from freshlane.operators import monitor as M  # noqa: E402


def _pred_eval(ctx):
    p = ctx.predictions
    return p.select("store_id", "product_id", "date", "model_version",
                    F.col("actual_demand").alias("y"), F.col("predicted_demand").alias("p"))


register("forecast_metrics", lambda ctx: E.forecast_metrics(_pred_eval(ctx), ["model_version"]))
register("business_cost", lambda ctx: E.business_cost(
    _pred_eval(ctx).join(F.broadcast(ctx.products.select("product_id", "unit_price", "cost_price")), "product_id"),
    ["model_version"]))


def _waste_eval(ctx):
    """Per row: L1 label, waste score (6 dp), split, filled lags, target."""
    f = ctx.features.select(*KEYS3, "quantity_sold", "sales_lag_1d", "sales_lag_7d", "units_wasted",
                            X_.to_dec(S.waste_score(), 16, 6).cast("double").alias("score"))
    labelled = L.add_waste_label(f).withColumnRenamed("waste_label", "label")
    return L.add_split(labelled, ctx.daily_sales, ctx.config)


register("classifier_metrics", lambda ctx: E.classifier_metrics(_waste_eval(ctx), ["split"]))
register("auc_roc", lambda ctx: E.auc_roc(_waste_eval(ctx), ["split"]))
register("average_precision", lambda ctx: E.average_precision(_waste_eval(ctx), ["split"]))
register("baseline_mape", lambda ctx: E.baseline_mape(
    _waste_eval(ctx).select("split", F.col("quantity_sold").alias("y"), F.col("sales_lag_1d").alias("lag1"),
                            F.col("sales_lag_7d").alias("lag7")), ["split"]))


# ---- drift / feedback / retrain (R1..R9) -----------------------------------------------------------
def _drift_inputs(ctx):
    fs = ctx.feature_store
    cut = L.split_cutoffs(ctx.daily_sales, ctx.config).select("c1").scalar()
    start = F.date_sub(fs.agg(F.max("date").alias("d")).select("d").scalar(), ctx.config.drift_recent_days)
    return fs, cut, start


def _psi(ctx):
    fs, cut, start = _drift_inputs(ctx)
    return M.psi(M.long_samples(fs, cut, start), ctx.config.psi_bins).select(
        "feature", F.round("psi", 6).alias("psi"))


def _ks(ctx):
    fs, cut, start = _drift_inputs(ctx)
    return M.ks(M.long_samples(fs, cut, start)).select(
        "feature", F.round("ks_statistic", 6).alias("ks_statistic"), F.round("p", 6).alias("p_value"))


def _drift_report(ctx):
    fs, cut, start = _drift_inputs(ctx)
    return M.drift_report(fs, cut, start, ctx.config)


register("psi_by_feature", _psi)
register("ks_by_feature", _ks)
register("drift_report", _drift_report)
register("drift_alert_row", lambda ctx: M.drift_alert_row(_drift_report(ctx)).select(
    "alert_type", "severity", "message", "n_drifted", "metadata"))


def _as_of_actuals(ctx):
    p = ctx.predictions
    return p.where(F.col("actual_demand").isNotNull()).agg(F.max("date").alias("d")).select("d").scalar()


def _rolling(ctx):
    return M.rolling_mape(ctx.predictions, _as_of_actuals(ctx))


register("rolling_mape_store", lambda ctx: _rolling(ctx).select("store_id", F.round("mape_raw", 4).alias("mape")))
register("mape_status", lambda ctx: _rolling(ctx).select(
    "store_id", F.round("mape_raw", 4).alias("mape"),
    M.mape_status(F.round("mape_raw", 4), ctx.config.mape_threshold).alias("degraded")))


def _feedback(ctx):
    r = _rolling(ctx).select("store_id", F.round("mape_raw", 4).alias("mape"))
    j = ctx.stores.select("store_id", "name").join(r, "store_id", "left")
    status = (F.when(F.col("mape").isNull(), "no data")
               .when(F.col("mape") > ctx.config.mape_threshold, "DEGRADED").otherwise("OK"))
    return j.select("store_id", "name", "mape", status.alias("status"))


register("feedback_report", _feedback)
register("forecast_error_histogram", lambda ctx: M.forecast_error_histogram(ctx.predictions))


def _retrain_triggers(ctx):
    """Schedule (no model_promoted alert, or >= 7 whole days before the log's last
    event), drift (an unacknowledged data_drift alert), MAPE degraded in any store."""
    a = ctx.alerts
    now = a.agg(F.max("created_at").alias("t")).select("t").scalar()
    last_promo = a.where(F.col("alert_type") == "model_promoted").agg(F.max("created_at").alias("t")) \
        .select("t").scalar()
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(last_promo)) / 86400)
    schedule = F.when(last_promo.isNull(), F.lit(True)).otherwise(days >= ctx.config.retrain_interval_days)
    drift = a.where((F.col("alert_type") == "data_drift") & ~F.col("acknowledged")).agg(
        (F.count(F.lit(1)) > 0).alias("x")).select("x").scalar()
    r = _rolling(ctx)
    degraded = r.agg(F.coalesce(F.max((F.round("mape_raw", 4) > ctx.config.mape_threshold).cast("int")),
                                F.lit(0)).alias("x")).select("x").scalar() == 1
    one = ctx.stores.agg(F.count(F.lit(1)).alias("n"))
    return one.select(schedule.alias("schedule"), drift.alias("drift"), degraded.alias("mape_degraded"),
                      (schedule | drift | degraded).alias("should_retrain"))


register("retrain_triggers", _retrain_triggers)


def _promotion_gate(ctx):
    """Candidate (v2) replaces current (v1) only when its MAPE is strictly lower."""
    m = E.forecast_metrics(_pred_eval(ctx), ["model_version"])
    cur = m.where(F.col("model_version") == "v1").select(F.col("mape").alias("current_mape"))
    new = m.where(F.col("model_version") == "v2").select(F.col("mape").alias("new_mape"))
    one = ctx.stores.agg(F.count(F.lit(1)).alias("n"))
    c, n = cur.select("current_mape").scalar(), new.select("new_mape").scalar()
    return one.select(c.alias("current_mape"), n.alias("new_mape"),
                      (c.isNull() | (n < c)).alias("promote"))


register("promotion_gate", _promotion_gate)


# ---- state (S3, S5, S6, S7, S10) and inventory updates (I3..I5) ----------------------------------------
from freshlane.operators import state as ST  # noqa: E402


def _fs_out(ctx):
    fs = ctx.feature_store
    return fs.select(*KEYS3, *[F.col(c).cast("double").alias(c) if "decimal" in ST.FEATURE_STORE_TYPES[c]
                               else F.col(c) for c in L.FEATURE_COLUMNS])


register("feature_store_projection", _fs_out)
register("load_features", lambda ctx: ST.select_features(_fs_out(ctx), store_id=1, date_from="2025-03-01",
                                                        date_to="2025-07-31"))
register("load_verification", lambda ctx: ST.load_verification(ctx))


def _actuals_batch(ctx):
    """The actuals a store posts: every sale of the last 3 days (not yet in predictions)."""
    s = ctx.daily_sales
    last = s.agg(F.max("date").alias("d")).select("d").scalar()
    return s.where(F.col("date") > F.date_sub(last, 3)).select(*KEYS3, F.col("quantity_sold").alias("actual_sold"))


def _record_actuals(ctx):
    p = ST.record_actuals(ctx.predictions, _actuals_batch(ctx))
    return p.where(F.col("date") > F.date_sub(p.agg(F.max("date").alias("d")).select("d").scalar(), 3)).select(
        *KEYS3, "model_version", "actual_demand", F.col("forecast_error").cast("double").alias("forecast_error"))


register("record_actuals", _record_actuals)


def _upsert(ctx):
    """Re-score the last 7 days (new values for v1) into the existing predictions."""
    p = ctx.predictions
    last = p.agg(F.max("date").alias("d")).select("d").scalar()
    new = (p.where((F.col("date") > F.date_sub(last, 7)) & (F.col("model_version") == "v1"))
           .select(*ST.PRED_KEY, (F.col("confidence_upper")).alias("predicted_demand"), "confidence_lower",
                   "confidence_upper", "waste_risk_score", "waste_risk_tier"))
    u = ST.upsert_predictions(p, new)
    return u.select(*ST.PRED_KEY, F.col("predicted_demand").cast("double").alias("predicted_demand"),
                    "actual_demand", "created_at")


register("upsert_predictions", _upsert)
register("update_with_actuals", lambda ctx: ST.update_with_actuals(ctx.predictions, _actuals_batch(ctx)).select(
    *KEYS3, "model_version", "actual_demand", F.col("forecast_error").cast("double").alias("forecast_error"), "created_at"))
register("apply_actuals_batch", lambda ctx: ST.apply_actuals_batch(ctx.predictions, _actuals_batch(ctx)))


def _update_rolling(ctx):
    """After an update, per store MAPE over date >= d - 7 days (no upper bound), x100, 1 dp, 0 -> NULL."""
    p = ST.record_actuals(ctx.predictions, _actuals_batch(ctx))
    last = p.agg(F.max("date").alias("d")).select("d").scalar()
    r = M.rolling_mape(p, last, 7, upper_bound=False)
    v = F.round(F.col("mape_raw") * 100, 1)
    return r.select("store_id", F.when(v == 0, F.lit(None)).otherwise(v).alias("rolling_mape_pct"))


register("update_rolling_mape", _update_rolling)


def _unknown_store_requests(ctx):
    """Requests whose store does not exist (store ids posted = sales stores shifted by 3)."""
    req = ctx.daily_sales.select((F.col("store_id") + 3).alias("store_id")).distinct()
    return req.join(ctx.stores.select("store_id"), "store_id", "left_anti")


register("unknown_store_requests", _unknown_store_requests)


def _site_visits(ctx):
    v = ST.site_visit_normalize(ctx.site_visit_events)
    return v.select("visit_id", "received_at", *ST.VISIT_COLUMNS)


register("site_visit_normalize", _site_visits)


# ---- data quality (Q1..Q8) -------------------------------------------------------------------------
from freshlane.operators import quality as Q  # noqa: E402

register("dq_duplicates", lambda ctx: Q.duplicates({
    "daily_sales": (ctx.daily_sales, KEYS3), "inventory_snapshots": (ctx.inventory_snapshots, KEYS3),
    "feature_store": (ctx.feature_store, KEYS3), "predictions": (ctx.predictions, KEYS3 + ["model_version"])}))
register("dq_nulls", lambda ctx: Q.nulls({
    "daily_sales": (ctx.daily_sales, KEYS3 + ["quantity_sold", "revenue"]),
    "inventory_snapshots": (ctx.inventory_snapshots, KEYS3 + ["quantity_on_hand", "reorder_point"])}))
register("dq_ranges", lambda ctx: Q.out_of_range([
    ("recommendations_log", ctx.recommendations_log, "markdown_pct", 0, 100)]))
register("dq_negative", lambda ctx: Q.out_of_range([
    ("daily_sales", ctx.daily_sales, "quantity_sold", 0, None),
    ("daily_sales", ctx.daily_sales, "units_wasted", 0, None),
    ("daily_sales", ctx.daily_sales, "units_donated", 0, None),
    ("daily_sales", ctx.daily_sales, "revenue", 0, None),
    ("inventory_snapshots", ctx.inventory_snapshots, "quantity_on_hand", 0, None)]))
register("dq_orphans", lambda ctx: Q.orphans([
    ("daily_sales", ctx.daily_sales, ctx.products, "product_id"),
    ("daily_sales", ctx.daily_sales, ctx.stores, "store_id"),
    ("inventory_snapshots", ctx.inventory_snapshots, ctx.products, "product_id"),
    ("products", ctx.products, ctx.categories, "category_id")]))
register("dq_feature_nulls", lambda ctx: Q.nulls({
    "feature_store": (ctx.feature_store, ["sales_lag_7d", "sales_rolling_7d_mean", "unit_price"])}))
register("dq_row_counts", lambda ctx: Q.row_counts([
    ("stores", ctx.stores, 1), ("products", ctx.products, 1), ("daily_sales", ctx.daily_sales, 5001),
    ("feature_store", ctx.feature_store, 0)]))
register("dq_requests", lambda ctx: Q.request_validity(
    R.waste_requests(ctx).unionByName(
        R.waste_requests(ctx).select((F.col("store_id") - 1).alias("store_id"), "product_id", "date",
                                     (F.col("current_stock") - 60).alias("current_stock"), "days_until_expiry")))
         .groupBy("status", "reason").agg(F.count(F.lit(1)).cast("long").alias("n")))


# ---- Spark ML models (M1, M3..M6, M8 with fitted models) -----------------------------------------------
from freshlane.operators import models as ML  # noqa: E402


def _ml_scored(ctx):
    m = ctx.ml
    d = ML.score_demand(m["demand"], m["leaves"], m["data"])
    return m["data"].select(*KEYS3, "split", "quantity_sold", "sales_lag_7d").join(d, KEYS3)


def _train_demand_model(ctx):
    """M1: test-split metrics of GBT, RF, the 0.6/0.4 ensemble and the naive lag-7 baseline."""
    m = ctx.ml
    s = m["demand"].transform(m["data"].where("split = 'test'").withColumn("label", F.lit(0.0)))
    ens = F.greatest(F.lit(0.0), F.lit(0.6) * F.col("p_gbt") + F.lit(0.4) * F.col("p_rf"))
    long = s.select("quantity_sold", F.explode(F.array(
        F.struct(F.lit("gbt").alias("model"), F.col("p_gbt").alias("p")),
        F.struct(F.lit("random_forest").alias("model"), F.col("p_rf").alias("p")),
        F.struct(F.lit("ensemble").alias("model"), ens.alias("p")),
        F.struct(F.lit("naive_lag7").alias("model"), F.col("sales_lag_7d").alias("p")))).alias("x"))
    return E.forecast_metrics(long.select("x.model", F.col("quantity_sold").alias("y"), "x.p"), ["model"])


register("train_demand_model", _train_demand_model)
register("score_demand_ml", lambda ctx: _ml_scored(ctx).select(
    *KEYS3, *[round6(c).alias(c) for c in ("predicted_demand", "confidence_lower", "confidence_upper")]))


def _importance(ctx):
    rows = [(n, float(v), i + 1) for i, (n, v) in enumerate(ML.feature_importance(ctx.ml["demand"]))]
    return ctx.spark.createDataFrame(rows, "feature string, importance double, rank int")


register("feature_importance", _importance)


def _waste_scored(ctx):
    m = ctx.ml
    return m["data"].select(*KEYS3, "split", "waste_label").join(ML.score_waste(m["waste"], m["data"]), KEYS3)


def _train_waste_model(ctx):
    """M5: per split precision / recall / f1 at 0.5, AUC and average precision."""
    s = _waste_scored(ctx).select("split", F.col("waste_label").alias("label"),
                                  F.round("waste_risk_score", 6).alias("score"))
    return (E.classifier_metrics(s, ["split"]).join(E.auc_roc(s, ["split"]), "split")
            .join(E.average_precision(s, ["split"]), "split"))


register("train_waste_model", _train_waste_model)
register("score_waste_ml", lambda ctx: _waste_scored(ctx).select(
    *KEYS3, round6("waste_risk_score").alias("waste_risk_score"), "waste_risk_tier"))


def _daily_forecast_ml(ctx):
    """M8 with the fitted models: latest feature row per pair on/before (last date - 7)."""
    m = ctx.ml
    f = ctx.features
    target = F.date_sub(f.agg(F.max("date").alias("d")).select("d").scalar(), 7)
    latest = A.latest_by(f.where(F.col("date") <= target), KEYS, "date")
    demand, waste = m.fitted("demand", "waste")
    d = ML.score_demand(demand, m["leaves"], latest)
    w = ML.score_waste(waste, latest)
    return d.join(w, KEYS3).select(*KEYS3, *[F.round(c, 2).alias(c) for c in
                                             ("predicted_demand", "confidence_lower", "confidence_upper")],
                                   F.round("waste_risk_score", 4).alias("waste_risk_score"), "waste_risk_tier")


register("daily_forecast_ml", _daily_forecast_ml)


# ---- streaming (T1..T3): run the stream to completion over the files present, read its sink --------------
from freshlane.streaming import streams as T  # noqa: E402


def _stream_site_visits(ctx):
    out, ck = T.stream_dirs(ctx.spark, "site_visits")
    T.run_once(T.site_visits(ctx.spark, ctx.sf_dir, out, ck))
    return T.read_site_visits(ctx.spark, out).select(
        "visit_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), *ST.VISIT_COLUMNS)


def _stream_actuals(ctx):
    out, ck = T.stream_dirs(ctx.spark, "actuals")
    T.run_once(T.actuals(ctx.spark, ctx.sf_dir, out, ck))
    return T.read_actuals(ctx.spark, out)


def _stream_daily_metrics(ctx):
    out, ck = T.stream_dirs(ctx.spark, "daily_metrics")
    T.run_once(T.daily_metrics(ctx.spark, ctx.sf_dir, out, ck))
    return T.read_daily_metrics(ctx.spark, out)


register("stream_site_visits", _stream_site_visits)
register("stream_actuals", _stream_actuals)
register("stream_daily_metrics", _stream_daily_metrics)


# ---- extensions (X1..X10, documented in the reference, not coded there) -----------------------------------
from freshlane.operators import extensions as X  # noqa: E402


def _r6all(df, keep):
    return df.select(*[F.round(c, 6).alias(c) if c not in keep else F.col(c) for c in df.columns])


register("ext_rolling", lambda ctx: _r6all(X.ext_rolling(ctx.daily_sales), KEYS3))
register("ext_trend", lambda ctx: _r6all(X.ext_trend(ctx.daily_sales), KEYS3))
register("ext_holiday_distance", lambda ctx: X.ext_holiday_distance(ctx.daily_sales))
register("ext_promo_day", lambda ctx: X.ext_promo_day(ctx.daily_sales))
register("ext_supply", lambda ctx: _r6all(X.ext_supply(ctx.features_raw_table, ctx.inventory_snapshots),
                                          KEYS3 + ["reorder_point_distance"]))
register("ext_price_change", lambda ctx: _r6all(X.ext_price_change(ctx.daily_sales), KEYS3))


def _ext_residual(ctx):
    cut = L.split_cutoffs(ctx.daily_sales, ctx.config).select("c1").scalar()
    return _r6all(X.ext_residual_interval(ctx.predictions, cut), KEYS3 + ["model_version"])


register("ext_residual_interval", _ext_residual)
register("ext_order_rules", lambda ctx: X.ext_order_rules(R.recommendation_inputs_daily(ctx)))


def _ext_kl(ctx):
    fs, cut, start = _drift_inputs(ctx)
    return X.ext_kl(M.long_samples(fs, cut, start))


register("ext_kl", _ext_kl)
register("ext_volume", lambda ctx: X.ext_volume(ctx.daily_sales))
register("ext_interval_width", lambda ctx: X.ext_interval_width(ctx.predictions))


def _ext_baselines(ctx):
    sp = L.time_split(ctx.daily_sales, ctx.config).where(F.col("split") == "test")
    return X.ext_baselines(ctx.features_raw_table.join(sp, KEYS3, "left_semi"))


register("ext_baselines", _ext_baselines)


# ---- S1: the training extract (daily_sales as stored; windows sort themselves, so no ORDER BY) ---------------
register("scan_daily_sales", lambda ctx: ctx.daily_sales.select(
    "store_id", "product_id", "date", "quantity_sold", F.col("revenue").cast("double").alias("revenue"),
    "units_wasted", "units_donated", "temperature_avg", "is_holiday", "is_promotion", "promotion_discount",
    "day_of_week"))
