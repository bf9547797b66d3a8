"""Event-time streams: windows, late rows and state; visits posted again; actuals applied exactly once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from freshlane.operators import durable as D
from freshlane.oracle.compare import compare, duck_connection
from freshlane.plans.context import Ctx
from freshlane.sources.monthly import new_root
from freshlane.streaming import event_time as ET
from freshlane.streaming.streams import run_once, stream_dirs


@pytest.fixture(scope="module")
def folder(spark, sf_small, tmp_path_factory):
    """Six files of lines, five by day and one of lines of all days, which arrives last; events in four, some posted twice."""
    folder = str(tmp_path_factory.mktemp("data") / "sf")
    os.makedirs(folder)
    for t in ("region", "nation", "supplier", "part", "orders", "customer"):
        shutil.copy(f"{sf_small}/{t}.parquet", folder)
    lines = spark.read.parquet(f"{sf_small}/lineitem.parquet").withColumn("odd", F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(10)) == 0)
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) % 240
    for k in range(6):
        part = lines.where("odd") if k == 5 else lines.where(~F.col("odd") & (F.floor(day / 48) == k))
        part.drop("odd").coalesce(1).write.mode("append").parquet(f"{folder}/lineitem.parquet")
    events = spark.read.parquet(f"{sf_small}/events.parquet")
    for part in (events.where("event_id % 3 = 0"), events.where("event_id % 3 = 1"), events.where("event_id % 3 = 0"),
                 events.where("event_id % 3 = 2")):
        part.orderBy("ts").coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return folder


def test_windows_and_late_rows(spark, sf_small, folder):
    out, ckpt = stream_dirs(spark, "windows")
    rows = ET.sales_events(spark, folder, max_files=1)
    query = ET.run_day_windows(spark, rows, out, ckpt, 20 * 86400, max_files=1)
    got = ET.read_day_windows(spark, out, rows.schema)
    late = got.agg(F.sum("late_lines").alias("n")).first()["n"]
    assert late > 0 and late == ET.dealt(spark, out, rows.schema, late=True).count()
    con = duck_connection(sf_small)
    sql = E.oracle_sql()["stream_day_windows"]
    assert compare(got.withColumn("late_lines", F.lit(0)), con, sql)[0] == "OK"
    closed = spark.read.parquet(f"{out}/result")
    assert closed.count() == closed.select("store_id", "start").distinct().count() > 0      # each window once
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 0
    held = max(s["numRowsTotal"] for s in state)
    assert state[-1]["numRowsTotal"] < held < got.count()      # days leave the state as they close
    # the same batches again change nothing
    before = sorted(map(str, got.collect()))
    ET.deal(out, rows_of(spark, out, rows.schema), 2, 20 * 86400)
    assert sorted(map(str, ET.read_day_windows(spark, out, rows.schema).collect())) == before


def rows_of(spark, out, schema):
    return ET.dealt(spark, out, schema, late=False).limit(10)


def test_rows_without_time_are_late(spark):
    out, _ = stream_dirs(spark, "deal")
    schema = "store_id int, event_time timestamp"
    one = spark.createDataFrame([(1, None)], schema)
    for i, batch in enumerate((spark.createDataFrame([], schema), one, one.withColumn("event_time", F.lit("2025-05-05").cast("timestamp")),
                               one)):
        ET.deal(out, batch, i, 60)
    assert ET.dealt(spark, out, one.schema, late=False).count() + ET.dealt(spark, out, one.schema, late=True).count() == 3
    assert ET.dealt(spark, out, one.schema, late=True).count() == 2


def test_visits_posted_again(spark, sf_small, folder):
    out, ckpt = stream_dirs(spark, "visits")
    rows = ET.visit_events(spark, folder, max_files=1)
    query = ET.run_visits(spark, rows, out, ckpt, 7200, max_files=1)
    state = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 0
    assert state[-1]["numRowsTotal"] < rows_total(spark, out, rows.schema)      # the state follows the delay, not the history
    from freshlane.operators.state import VISIT_COLUMNS
    got = ET.read_visits(spark, out, rows.schema).select(
        "visit_id", F.col("received_at").cast("timestamp_ntz").alias("received_at"), *VISIT_COLUMNS)
    status, ns, nd = compare(got, duck_connection(sf_small), E.oracle_sql()["stream_visits_once"])
    assert status == "OK", (status, ns, nd)


def rows_total(spark, out, schema):
    return ET.dealt(spark, out, schema, late=False).count()


def test_actuals_exactly_once(spark, sf_small, folder):
    ctx = Ctx(spark, sf_small)
    con = duck_connection(sf_small)
    table = D.predictions_store(spark, new_root(spark, "predictions"), ctx.predictions)
    totals = ET.totals_table(spark, new_root(spark, "actuals"))
    _, ckpt = stream_dirs(spark, "actuals")
    run_once(ET.run_actuals(spark, folder, totals, table, ckpt, max_files=2))
    numbers = ("predicted_demand", "confidence_lower", "confidence_upper", "waste_risk_score", "forecast_error")
    shown = lambda: table.read().select(*[F.col(c).cast("double").alias(c) if c in numbers else F.col(c) for c in table.schema.names])
    status, ns, nd = compare(shown(), con, E.oracle_sql()["stream_predictions"])
    assert status == "OK", (status, ns, nd)
    n, batch = table.state()["n"], spark.read.parquet(f"{ckpt}/staged/1")
    ET.apply_batch(batch, 1, totals, table, f"{ckpt}/again")          # replayed
    assert table.state()["n"] == n
    # a failure between the two commits: the totals have the batch, the predictions do not
    day = batch.limit(1).select("store_id", "product_id", "date", F.lit(7).cast("long").alias("q"))
    D.add_actuals(totals, day, "actuals", 3)
    ET.apply_batch(day, 3, totals, table, f"{ckpt}/again")
    keys = ["store_id", "product_id", "date"]
    total = totals.read().join(day.select(*keys), keys).first()["q"]
    newest = table.read().join(day.select(*keys), keys).orderBy(F.desc("created_at")).first()
    assert newest["actual_demand"] == total == ctx.daily_sales.join(day.select(*keys), keys).first()["quantity_sold"] + 7
