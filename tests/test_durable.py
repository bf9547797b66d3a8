"""Month tables: atomic commits, merges of touched months only, replays, feature appends equal to a rebuild."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from freshlane.operators import durable as D
from freshlane.operators import state as ST
from freshlane.plans.context import Ctx
from freshlane.sources.monthly import CommitConflict, MonthTable, new_root

KEYS3 = ["store_id", "product_id", "date"]


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def ctx(spark, sf_small):
    return Ctx(spark, sf_small)


@pytest.fixture()
def store(spark, ctx):
    return D.predictions_store(spark, new_root(spark, "predictions"), ctx.predictions)


def test_merge_rewrites_only_touched_months(spark, ctx, store):
    before = store.state()
    day = ctx.predictions.agg(F.max("date").alias("d")).first()["d"]
    new = ctx.predictions.where(F.col("date") == F.lit(day)).select(*ST.PRED_KEY, *ST.PRED_VALUES)
    assert D.upsert(store, new.withColumn("predicted_demand", F.lit(1.5).cast("decimal(16,6)")))
    after = store.state()
    month = f"{day:%Y-%m}"
    assert {m for m in after["months"] if after["months"][m] != before["months"].get(m)} == {month}
    assert after["n"] == before["n"] + 1 and store.read().count() == ctx.predictions.count()
    assert store.read([month]).where(F.col("date") == F.lit(day)).where("predicted_demand <> 1.5").count() == 0
    assert same(store.read(state=before), ctx.predictions)      # a reader of the old commit still sees it
    store.clean(keep=1)
    assert store.read().count() == ctx.predictions.count()
    plan = store.read([month])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ym=") <= len(after["months"][month]) + 1


def test_upsert_inserts_and_updates_once(spark, ctx, store):
    old = ctx.predictions.where("model_version = 'v1'").limit(3)
    new = old.unionByName(old.withColumn("model_version", F.lit("v9"))).select(*ST.PRED_KEY, *ST.PRED_VALUES)
    now = F.lit(dt.datetime(2030, 1, 1)).cast("timestamp_ntz")
    D.upsert(store, new, now)
    first = store.read()
    added = first.where("model_version = 'v9'")
    assert added.count() == 3 and added.where("created_at <> timestamp_ntz'2030-01-01' OR actual_demand IS NOT NULL").count() == 0
    assert first.count() == ctx.predictions.count() + 3
    held = first.collect()
    D.upsert(store, new, F.lit(dt.datetime(2031, 1, 1)).cast("timestamp_ntz"))
    assert sorted(map(str, store.read().collect())) == sorted(map(str, held))


def test_replayed_batch_changes_nothing(spark, ctx, store):
    items = ctx.daily_sales.limit(5).select(*KEYS3, F.col("quantity_sold").cast("long").alias("q"))
    assert D.apply_actuals(store, items, "s", 4)
    n = store.state()["n"]
    assert not D.apply_actuals(store, items, "s", 4) and not D.apply_actuals(store, items, "s", 3)
    assert store.state()["n"] == n and store.done("s") == 4 and store.done("other") == -1


def test_two_writers_from_one_commit(spark, ctx, store):
    base = store.state()
    rows = ctx.predictions.limit(2)
    store.commit(rows, base)
    with pytest.raises(CommitConflict):
        store.commit(rows, base)
    assert store.read().count() == ctx.predictions.count() + 2


def test_empty_and_new_months(spark):
    schema = "date date, x int"
    table = MonthTable(spark, new_root(spark, "t"), spark.createDataFrame([], schema).schema)
    assert table.read().count() == 0 and table.read(["2025-01"]).count() == 0
    add = lambda old, new: old.unionByName(new)
    assert not table.merge(spark.createDataFrame([], schema), add)
    for month in (1, 2, 2):
        table.merge(spark.createDataFrame([(dt.date(2025, month, 3), month)], schema), add)
    assert sorted(r.x for r in table.read().collect()) == [1, 2, 2] and table.read(["2025-02"]).count() == 2
    for i in range(12):     # appends do not pile up folders
        table.append(spark.createDataFrame([(dt.date(2025, 3, 3), i)], schema), table.state())
    assert table.read(["2025-03"]).count() == 12 and len(table.state()["months"]["2025-03"]) <= 8


def test_appended_days_equal_a_rebuild(spark, ctx):
    sales, inventory = ctx.daily_sales, ctx.inventory_snapshots
    last = sales.agg(F.max("date").alias("d")).first()["d"]
    table = D.FeatureTable(spark, new_root(spark, "features"), ctx.products, ctx.stores)
    number = lambda d: (d - dt.date(1970, 1, 1)).days
    cuts = [last - dt.timedelta(days=k) for k in (200, 90, 31, 2, 1, 0)]      # long gaps, single days
    for since, day in zip([dt.date(1900, 1, 1), *cuts], cuts):
        part = F.col("date").between(F.lit(since) + F.expr("INTERVAL 1 DAY"), F.lit(day))
        assert table.append(sales.where(part), inventory.where(part), number(day))
    assert not table.append(sales, inventory, number(last))      # already there
    want = ctx.features_raw_table
    assert table.read().columns == want.columns
    shown = lambda df: df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    assert same(shown(table.read()), shown(want))


def test_stored_series_need_no_exchange(spark, ctx):
    from freshlane.plans.durable_queries import stored_features
    found = stored_features(ctx, buckets=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Exchange SinglePartition" not in plan and "Bucketed: true" in plan
    want = ctx.features_raw_table
    assert same(found.select(*want.columns), want)
