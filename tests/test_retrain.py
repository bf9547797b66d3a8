"""Champion and challenger: both outcomes, the alerts, the schedule, a roll-back."""

import datetime as dt
import json

from pyspark.sql import functions as F

from freshlane.operators import models as M
from freshlane.operators import retrain as RT
from freshlane.plans.context import Ctx
from freshlane.sources.monthly import new_root

DEEP = M.ModelParams(gbt_iter=8, gbt_step=0.3, gbt_depth=4, rf_trees=8, rf_depth=4, waste_iter=3, interval_depth=3)
FLAT = M.ModelParams(gbt_iter=1, gbt_step=0.01, gbt_depth=1, rf_trees=1, rf_depth=1, waste_iter=1, interval_depth=1)


def when(day):
    return F.lit(dt.datetime(2025, 9, day)).cast("timestamp_ntz")


def test_cycle(spark, sf_small):
    ctx = Ctx(spark, sf_small)
    store = RT.ModelStore(spark, new_root(spark, "models"))
    log = RT.alert_log(spark, new_root(spark, "alerts"))
    due = lambda day: spark.range(1).select(RT.schedule_due(log, when(day), 7).alias("x")).first()["x"]
    assert due(1) and store.current() is None
    first = RT.retrain(ctx.features, store, log, when(1), DEEP).first()
    assert first["promoted"] and first["current_mape"] is None and first["version"] == 1 and first["alert_type"] == "model_promoted"
    assert not due(7) and due(8)
    second = RT.retrain(ctx.features, store, log, when(2), FLAT).first()      # on this small table the flat model has the lower MAPE
    assert second["current_mape"] == first["new_mape"]          # the stored champion, on the same test rows
    assert second["new_mape"] < second["current_mape"] and second["promoted"] and store.current() == 2
    third = RT.retrain(ctx.features, store, log, when(3), DEEP).first()
    assert third["new_mape"] > third["current_mape"] == second["new_mape"]
    assert not third["promoted"] and third["alert_type"] == "retrain_completed" and store.current() == 2
    equal = RT.retrain(ctx.features, store, log, when(4), FLAT).first()
    assert equal["new_mape"] == equal["current_mape"] and not equal["promoted"]      # strictly lower only
    assert RT.roll_back(store, log, when(5)) == 1 and store.current() == 1
    rows = {(r.date.day, r.message): r for r in log.read().collect()}
    assert [r.alert_type for _, r in sorted(rows.items())] == ["model_promoted"] * 2 + ["retrain_completed"] * 2 + ["model_rollback"] * 2
    by_day = {d: r for (d, _), r in rows.items()}
    assert by_day[1].message == f"New model promoted: MAPE={first['new_mape']:.4f}"
    assert json.loads(by_day[2].metadata_json)["demand"]["mape"] == second["new_mape"]
    assert set(json.loads(by_day[3].metadata_json)) == {"new", "current"} and not any(r.acknowledged for r in rows.values())
    assert (5, "Model 'demand' rolled back from v2 to v1") in rows
    scored = M.score_demand(store.load("demand", 1), store.leaves(1), ctx.features.limit(20))
    assert scored.count() == 20 and store._pointers() == [1, 2, 1]


def test_drift_alert_is_appended(spark):
    log = RT.alert_log(spark, new_root(spark, "alerts"))
    report = spark.createDataFrame([("high", "Data drift detected in 3 feature(s): a, b, c", "{}")],
                                   "severity string, message string, metadata_json string")
    assert RT.append_drift_alert(log, report, when(1)) and not RT.append_drift_alert(log, report.limit(0), when(1))
    assert [(r.alert_type, r.severity) for r in log.read().collect()] == [("data_drift", "high")]
