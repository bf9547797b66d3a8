"""Sinks and state: feature store save / load with pushed predicates, metrics JSON, upsert semantics."""

import os
import uuid

from pyspark.sql import functions as F

from freshlane.operators import state as ST
from freshlane.plans.context import Ctx
from freshlane.session import ensure_checkpoint_dir


def _path(spark, name):
    return os.path.join(ensure_checkpoint_dir(spark), "test-out", f"{name}-{uuid.uuid4().hex[:8]}")


def test_feature_store_roundtrip_with_pushdown(spark, sf_small):
    ctx = Ctx(spark, sf_small)
    path = _path(spark, "fs")
    n = ST.save_features(ctx.features, path)
    assert n == ctx.daily_sales.count()
    df = ST.load_features(spark, path, store_id=1, date_from="2025-03-01", date_to="2025-03-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "store_id" in plan
    assert df.where((F.col("store_id") != 1) | (F.col("date") < "2025-03-01")).count() == 0
    assert set(df.columns) == {"store_id", "product_id", "date", *ST.FEATURE_STORE_TYPES}


def test_upsert_keeps_actuals_and_created_at(spark, sf_small):
    ctx = Ctx(spark, sf_small)
    p = ctx.predictions
    new = p.limit(5).select(*ST.PRED_KEY, F.lit(1.5).cast("decimal(16,6)").alias("predicted_demand"),
                            "confidence_lower", "confidence_upper", "waste_risk_score", "waste_risk_tier")
    u = ST.upsert_predictions(p, new)
    assert u.count() == p.count()
    changed = u.join(new.select(*ST.PRED_KEY), ST.PRED_KEY)
    assert changed.where(F.col("predicted_demand") != 1.5).count() == 0
    before = p.join(new.select(*ST.PRED_KEY), ST.PRED_KEY).select(*ST.PRED_KEY, "actual_demand", "created_at")
    after = changed.select(*ST.PRED_KEY, "actual_demand", "created_at")
    assert before.exceptAll(after).count() == 0


def test_metrics_json(spark):
    dm = spark.createDataFrame([("ensemble", 0.2, 3.0), ("naive_lag7", 0.4, 5.0)], "model string, mape double, rmse double")
    wm = spark.createDataFrame([("test", 0.7, 0.6)], "split string, auc_roc double, f1 double")
    path = _path(spark, "metrics")
    ST.write_metrics_json(ST.train_metrics_row(dm, wm, None, 12.3456), path)
    r = spark.read.json(path).first()
    assert (r["demand_mape"], r["waste_auc"], r["naive_lag7_mape"], r["elapsed_sec"]) == (0.2, 0.7, 0.4, 12.346)


def test_posted_payloads(spark):
    rows = [(1, '{"source": "web", "city": null, "latitude": 1.5, "other": 3}'), (2, "{}"), (3, None), (4, "[1]"), (5, '{"source": "web'),
            (6, '{"source": "' + "s" * 21 + '", "ip": ""}'), (7, '{"latitude": null, "referrer": "r"}')]
    raw = spark.createDataFrame([(i, None, p, " 1.1.1.1 , 2.2.2.2" if i == 6 else "", "9.9.9.9") for i, p in rows],
                                "visit_id long, received_at timestamp, payload_json string, x_forwarded_for string, client_host string")
    got = {r.visit_id: r for r in ST.site_visits_posted(raw).collect()}
    assert [got[i].reason for i in range(1, 8)] == [None, None, "payload", "payload", "payload", "source", None]
    assert [got[i].payload_json for i in (1, 2, 3, 5, 7)] == ['{"source":"web","latitude":1.5}', "{}", None, None, '{"referrer":"r"}']
    assert got[6].ip == "1.1.1.1" and got[1].ip == "9.9.9.9" and got[7].referrer == "r" and got[1].referrer == ""
